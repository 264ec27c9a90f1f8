"""Phrase collocations: frequent word sequences that are far more common than their parts suggest."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodehours.llm.common import Folder, body, checked
from nodehours.llm.tally import got, got_sorted, put, put_sorted
from nodehours.llm.trie import DoubleArray
from nodehours.llm.words import MIX, mixed, sliced

BLOCK_BYTES = 4 << 20  # text of a block
WAITING_BYTES = 12 << 20  # texts of all languages that wait in a task for their blocks
SLICE = 1 << 18  # words of a block that are worked on together
ROOM = 8  # counters of hashed phrases of one length for each word of the corpus; whatever shares one only makes more candidates
RANGE = 1 << 21  # words of the corpus for each range of counters
HASHES, WINDOWS = 1 << 21, 1 << 19  # phrases and windows that wait in a task before equal ones are made one
BITS = 64  # of a sieve for each counter it holds, SIEVE_BITS in all at most; fewer only make more candidates
SIEVE_BITS = 1 << 28
SHARES = 64  # ranges of counters and tries, at least
PART = 500_000  # words of the corpus for each trie, times the lengths of phrases from 2 on
WORD_BYTES = 16 << 20  # frequent words that may be broadcast; the join shuffles beyond
PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"

_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(PIECE_ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words as numbers into a vocabulary, -1 between two pieces, and the vocabulary.

    Letters A-Z are lowered; pieces end at texts' ends and PIECE_ENDS, words at SPACES as well. Bytes decide, as all of
    these are ASCII. Null texts have no words.
    """
    texts = pc.fill_null(texts, "")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0]:at[-1]]
    kind = _KIND[data]
    inside = kind == 0
    opens = np.zeros(len(data), bool)
    opens[(at[:-1] - at[0])[at[1:] > at[:-1]]] = True
    starts = np.flatnonzero(inside & (opens | ~np.concatenate([[False], inside[:-1]])))
    kept = _LOWER[data[inside]]
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, len(kept)).astype(np.int32)
    said = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    coded = pc.dictionary_encode(said)
    ends = np.cumsum((kind == 2) | opens, dtype=np.int32)[starts]
    place = np.arange(len(starts)) + np.cumsum(np.diff(ends, prepend=ends[:1]) != 0)
    codes = np.full(place[-1] + 1 if len(place) else 0, -1, np.int32)
    codes[place] = np.asarray(coded.indices)
    return codes, coded.dictionary


BLOCK = "block long, lang string, codes binary, vocabulary array<string>, counts array<long>"


def _encoded(block: int, lang: str, texts: list[pa.Array]) -> pa.RecordBatch:
    codes, vocabulary = pieces(pa.concat_arrays(texts))
    counts = np.bincount(codes[codes >= 0], minlength=len(vocabulary)).astype(np.int64)
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    return pa.record_batch({"block": pa.array([block], pa.int64()), "lang": pa.array([lang]), "codes": pa.array([put(codes)], pa.binary()),
                            "vocabulary": one(vocabulary), "counts": one(pa.array(counts))})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one language in blocks."""
    at = TaskContext.get().partitionId() << 32
    waiting: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    for batch in sliced(batches, most_bytes=BLOCK_BYTES // 4):
        langs = pc.dictionary_encode(batch["lang"])
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            text = batch["text"].filter(pc.equal(langs.indices, k))
            waiting.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + text.nbytes
        full = [x for x in waiting if size[x] >= BLOCK_BYTES or sum(size.values()) >= WAITING_BYTES]
        for lang in full:
            size.pop(lang)
            yield _encoded(at, lang, waiting.pop(lang))
            at += 1
    for lang, texts in waiting.items():
        yield _encoded(at, lang, texts)
        at += 1


class Block:
    """Words of a block: local numbers, and the corpus-wide number of each frequent word (-1 for others)."""

    def __init__(self, batch: pa.RecordBatch, k: int) -> None:
        row = batch.slice(k, 1)
        self.lang, self.codes = row["lang"][0].as_py(), got(row["codes"][0].as_py(), "<i4")
        self.ids = np.full(row["n_vocabulary"][0].as_py() + 1, -1, np.int64)  # the last one is that of piece ends
        self.ids[row["at"].flatten().to_numpy()] = row["id"].flatten().to_numpy()

    def slices(self, most_words: int) -> Iterator[np.ndarray]:
        """The numbers in stretches of SLICE and the words behind that a phrase may reach."""
        for lo in range(0, len(self.codes), SLICE):
            yield self.codes[lo:lo + SLICE + most_words - 1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(batch, k)


class Sieve:
    """Bits that tell which counters reach the least frequency; a few others pass as well."""

    def __init__(self, keys: list[np.ndarray], shift: int) -> None:
        most = max(1 << 16, BITS * sum(map(len, keys)))
        self.shift, self.mask = np.uint64(shift), np.uint64(min(SIEVE_BITS, 1 << (most - 1).bit_length()) - 1)
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)
        for some in keys:
            for at in self._places(some):
                np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(keys * MIX)
        return h & self.mask, (h >> np.uint64(32)) & self.mask

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes whose counters pass."""
        hit = np.arange(len(h))
        for t in range(2):
            at = self._places(h[hit] >> self.shift)[t]
            hit = hit[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return hit


def _grams(codes: np.ndarray, ids: np.ndarray, key: np.ndarray, kept: list[Sieve], most_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of 2 words on: where in a stretch Apriori-safe phrases start, their hashes, and places in the length before.

    A phrase is safe if both phrases one word shorter are safe and its counter reaches the least frequency; for two words,
    if both words are frequent. kept holds a sieve for each length known so far.
    """
    at = np.flatnonzero((ids >= 0)[codes])
    h = key[codes[at]]
    for k in range(2, most_words + 1):
        pair = np.flatnonzero(np.diff(at) == 1)
        at = at[pair]
        h = mixed(h[pair] * MIX + key[codes[at + k - 1]])
        if k - 2 < len(kept):
            hit = kept[k - 2].passing(h)
            at, h, pair = at[hit], h[hit], pair[hit]
        yield k, at, h, pair


def _keys(ids: np.ndarray) -> np.ndarray:
    return mixed(ids.astype(np.uint64) * MIX)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _reached(blocks: DataFrame, kept: list[Sieve], k: int, least: int, n: int) -> Sieve:
    """Which counters of hashed safe phrases of k words reach the least frequency.

    There are ROOM counters for each of the n words, so they follow the corpus. Those that a task has met are handed over in
    ranges; counts of all tasks stream through the task that sums a range.
    """
    wide = max(20, (ROOM * n - 1).bit_length())  # bits of a counter's number
    ranges = max(SHARES, -(-n // RANGE))
    edges = np.array([-(-(i << wide) // ranges) for i in range(ranges)], np.uint64)
    shift = np.uint64(64 - wide)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def handed() -> pa.RecordBatch:
            keys = np.sort(np.concatenate([*waiting, np.zeros(0, np.uint64)]))
            waiting.clear()
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
            counts = np.minimum(np.diff(np.append(first, len(keys))), least).astype("<u4")
            keys = keys[first]
            cut = np.append(np.searchsorted(keys, edges), len(keys)).tolist()
            full = [i for i in range(ranges) if cut[i] < cut[i + 1]]
            return pa.record_batch({"range": pa.array(full, pa.int64()),
                                    "keys": pa.array([put_sorted(keys[cut[i]:cut[i + 1]]) for i in full], pa.binary()),
                                    "counts": pa.array([put(counts[cut[i]:cut[i + 1]]) for i in full], pa.binary())})

        for b in _rows(batches):
            key = _keys(b.ids)
            for codes in b.slices(k):
                *_, (_, _, h, _) = _grams(codes, b.ids, key, kept, k)
                waiting.append(h >> shift)
                if sum(map(len, waiting)) >= HASHES:
                    yield handed()
        yield handed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, "range"):
            sums, waiting = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []
            for row in rows:
                waiting.append((got_sorted(row["keys"]), got(row["counts"], "<u4").astype(np.int64)))
                if sum(len(w[0]) for w in waiting) > max(1 << 20, len(sums[0])):
                    sums, waiting = _summed(*map(np.concatenate, zip(sums, *waiting, strict=True))), []
            keys, counts = _summed(*map(np.concatenate, zip(sums, *waiting, strict=True)))
            yield pa.record_batch({"keys": pa.array([put_sorted(keys[counts >= least])], pa.binary())})

    sums = blocks.mapInArrow(count, "range long, keys binary, counts binary").repartition("range").sortWithinPartitions("range")
    return Sieve([got_sorted(r["keys"]) for r in sums.mapInArrow(add, "keys binary").collect()], int(shift))


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows of one value after the other, of rows in the order of that column."""
    return groupby((row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist()), key=lambda r: r[by])


def _put_rows(rows: np.ndarray) -> bytes:
    """Column after column, byte planes apart, so that leading zeros take no room; -1 becomes 0."""
    n, width = rows.shape
    return put(np.ascontiguousarray(np.ascontiguousarray((rows + 1).T).view(np.uint8).reshape(width, n, 8).transpose(0, 2, 1)))


def _got_rows(b: bytes, width: int) -> np.ndarray:
    planes = got(b, "u1").reshape(width, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(width, -1).T - 1


def _distinct(rows: np.ndarray, key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows made one, in the order of a hash. Rows are compared; unlike ones of one hash may leave some that stand twice."""
    order = np.argsort(key)
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    first = np.flatnonzero(new)
    return rows[first], key[order][first], np.add.reduceat(counts[order], first) if len(first) else counts


def _windows(blocks: DataFrame, kept: list[Sieve], most_words: int, parts: int) -> DataFrame:
    """part, windows and counts: from every position on, the words of the longest safe phrase (-1 behind them), equal ones counted.

    All phrases that begin with the same two words are in one part.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def handed() -> pa.RecordBatch:
            rows, key = (np.concatenate(x) for x in zip((np.zeros((0, most_words), np.int64), np.zeros(0, np.uint64)), *waiting, strict=True))
            waiting.clear()
            rows, key, counts = _distinct(rows, key, np.ones(len(rows), np.int64))
            part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cut = np.append(np.flatnonzero(np.diff(part, prepend=-1) != 0), len(part)).tolist()
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            return pa.record_batch({"part": pa.array([int(part[lo]) for lo, _ in spans], pa.int64()),
                                    "windows": pa.array([_put_rows(rows[lo:hi]) for lo, hi in spans], pa.binary()),
                                    "counts": pa.array([put(counts[lo:hi].astype("<u4")) for lo, hi in spans], pa.binary())})

        for b in _rows(batches):
            key = _keys(b.ids)
            for codes in b.slices(most_words):
                for k, at, h, before in _grams(codes, b.ids, key, kept, most_words):
                    place = np.arange(len(at)) if k == 2 else place[before]
                    if k == 2:
                        own, pairs, last = at < SLICE, h, h.copy()  # others start in the next stretch
                        rows = np.full((len(at), most_words), -1, np.int64)
                        rows[:, 0] = b.ids[codes[at]]
                    rows[place, k - 1] = b.ids[codes[at + k - 1]]
                    last[place] = h
                waiting.append((rows[own], ((pairs >> np.uint64(32) << np.uint64(32)) | last >> np.uint64(32))[own]))
                if sum(len(w[1]) for w in waiting) >= WINDOWS:
                    yield handed()
        yield handed()

    return blocks.mapInArrow(emit, "part long, windows binary, counts binary")


def _counted(windows: DataFrame, names: list[str], least: int) -> DataFrame:
    """w1, w2, .. (-1 behind the last word) and a: the candidates that occur a >= least times.

    Candidates of a part are the beginnings of its windows. They enter a trie, which is matched from the start of all windows of the
    part at once; a state it accepts has the sum of the counts of the windows that reach it.
    """
    width = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, "part"):
            sums, waiting = (np.zeros((0, width), np.int64), np.zeros(0, np.int64)), []

            def merged(sums: tuple, waiting: list) -> tuple[np.ndarray, np.ndarray]:
                every, counts = map(np.concatenate, zip(sums, *waiting, strict=True))
                key = np.zeros(len(every), np.uint64)
                for w in every.T:
                    key = mixed(key * MIX + w.astype(np.uint64))
                every, _, counts = _distinct(every, key, counts)
                return every, counts

            for row in rows:
                waiting.append((_got_rows(row["windows"], width), got(row["counts"], "<u4").astype(np.int64)))
                if sum(len(w[1]) for w in waiting) > max(1 << 18, len(sums[1])):
                    sums, waiting = merged(sums, waiting), []
            every, counts = merged(sums, waiting)
            order = np.lexsort(every.T[::-1])
            every, counts = every[order], counts[order]
            candidates, new = [], np.zeros(len(every), bool)
            new[:1] = True
            for k in range(1, width + 1):  # beginnings of k words, where the window before has another one
                new[1:] |= every[1:, k - 1] != every[:-1, k - 1]
                if k > 1:
                    some = every[new & (every[:, k - 1] >= 0)]
                    some[:, k:] = -1
                    candidates.append(some)
            candidates = np.concatenate(candidates)
            trie = DoubleArray(candidates, np.arange(len(candidates)))
            total = np.zeros(len(trie.check), np.int64)
            trie.walk(trie.codes_of(every.ravel()), np.arange(0, every.size, width), total, counts)
            accepts = np.flatnonzero((trie.label >= 0) & (total >= least))
            found = candidates[trie.label[accepts]]
            yield pa.record_batch([*map(pa.array, found.T.copy()), pa.array(total[accepts])], [*names, "a"])

    dealt = windows.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(count, ", ".join(f"{n} long" for n in [*names, "a"]))


def _score() -> Column:
    """floor(1000 * a * n / (l * r)), by decimals of 38 digits."""
    big = "cast({} AS decimal(38,0))"
    return F.expr(f"({big.format(1000)} * a * n) div ({big.format('l')} * r)")


def collocations(docs: DataFrame, most_words: int = 5, least: int = 100, percent: int = 100, top: int = 2000,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are cut into pieces and words (see pieces). A candidate is a phrase of 2 to most_words words that occurs
    a >= least times; n counts all words of its language. Of its cuts into two parts with l and r occurrences the one with the
    lowest floor(1000 * a * n / (l * r)) counts, the earliest of equals. Candidates inside a longer one with at least percent of
    their occurrences go; of the rest the first top by score, then a, then phrase (in the order of its bytes) come back.

    Blocks of texts are encoded once. Candidates are found level by level: hashed counters, whose number follows the corpus,
    first drop what cannot reach the least frequency; the distinct phrases left, all of whose parts are left, enter double-array
    tries, one for each part of the pairs of words they begin with, which give exact counts. Null text has no words;
    null lang is und. Repeated rows count each. Other columns are ignored; an empty table, or one without candidates, gives
    no rows.
    """
    spark = docs.sparkSession
    folder = Folder(spark, "phrases")
    names = [f"w{i + 1}" for i in range(most_words)]
    rows = docs.select(body(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    raw = folder.put(rows.mapInArrow(_blocks, BLOCK), "raw")
    vocabulary = raw.select("block", "lang", F.posexplode(F.arrays_zip(F.col("vocabulary").alias("word"), F.col("counts").alias("n"))).alias("at", "x"))
    totals = raw.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    totals = folder.put(totals, "totals")
    words = vocabulary.groupBy("lang", "x.word").agg(F.sum("x.n").alias("f")).where(F.col("f") >= least)
    words = folder.put(words.withColumn("id", F.monotonically_increasing_id()), "words")
    size = words.agg(F.sum(F.octet_length("word") + F.octet_length("lang") + 24)).first()[0] or 0
    near = F.broadcast if size <= WORD_BYTES else lambda df: df
    known = vocabulary.select("block", "lang", "at", "x.word").join(near(words), ["lang", "word"], "left").groupBy("block").agg(
        F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id"))).alias("known"))
    blocks = raw.select("block", "lang", "codes", F.size("vocabulary").alias("n_vocabulary")).join(known, "block")
    blocks = folder.put(blocks.select("lang", "codes", "n_vocabulary", F.col("known.at").alias("at"), F.col("known.id").alias("id")), "blocks")
    folder.drop("raw")

    n = totals.agg(F.sum("n")).first()[0] or 0
    kept: list[Sieve] = []
    for k in range(2, most_words + 1):
        kept.append(_reached(blocks, kept, k, least, n))
    parts = max(SHARES, -(-n // ((most_words - 1) * PART)))
    counts = _counted(_windows(blocks, kept, most_words, parts), names, least)
    ids = F.filter(F.array(*names), lambda w: w >= 0)
    found = counts.join(near(words.select(F.col("id").alias("w1"), "lang")), "w1")
    found = folder.put(found.select("lang", ids.alias("ids"), F.size(ids).alias("k"), "a"), "found")
    folder.drop("blocks")

    every = found.select(F.col("ids").alias("part"), "a").unionByName(words.select(F.array("id").alias("part"), F.col("f").alias("a")))
    every = folder.put(every, "every")
    cuts = found.join(checked(totals), "lang").select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("cut")), "right": F.slice("ids", F.col("cut") + 1, F.col("k") - F.col("cut"))})
    cuts = (cuts.join(every.select(F.col("part").alias("left"), F.col("a").alias("l")), "left")
            .join(every.select(F.col("part").alias("right"), F.col("a").alias("r")), "right"))
    best = cuts.groupBy("lang", "ids", "k", "a", "n").agg(F.min(F.struct(_score().alias("score"), "cut", "l", "r")).alias("s"))

    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> slice(ids, i, m))))")
    around = found.where("k > 2").select(F.explode(inner).alias("part"), "a").groupBy("part").agg(F.max("a").alias("longer"))
    best = best.join(around, best["ids"] == around["part"], "left").where(f"longer IS NULL OR 100 * longer < {int(percent)} * a")
    best = folder.put(best.select("lang", "ids", "a", "n", "s.score", "s.l", "s.r"), "best")

    spelled = best.select("ids", F.posexplode("ids").alias("i", "id")).join(near(words.select("id", "word")), "id").groupBy("ids").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = best.join(spelled, "ids").withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
