"""Fuzzy removal of repeated lines."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodehours.llm.common import Folder, body, checked as counted
from nodehours.llm.components import components

RADIUS = 3  # bits of 64 in which fingerprints of lines may differ that are sure to share a choice of blocks
LOOSE = 8  # bits in which those may differ that do share one; their edit distance is looked at
FAR = 27  # bits in which fingerprints of candidates by word pairs may differ; those of unrelated lines differ in 32, give or take 4
BINS = 16  # bins of word pairs; the rarest of each is a key of the line
GROUP = {"blocks": 16, "pairs": 64}  # lines of a group, by kind of key, that are all paired with each other
CROWD = 4096  # lines of a larger group that is not connected yet which are still paired by their numbers; beyond, they are by shared words
PASS = 10_000_000  # words of such lines that are on disk together, or an eighth of all words if that is more
RARE = 33 + 2 * 17  # counter of a word pair (33 and twice the binary logarithm) up to which fewer than 2**17.5 lines can have it as a key
SLICE = 8  # keys of a line that are looked at together
LANE = 16  # bits of a sum of weights, four to a number
MOST_CHARS = 1 << (LANE - 1)  # such a sum stays below, and weights add up to less than the characters of a line
WIDE = 32  # the same for lines too long for such sums
PARITY = 128  # bits that tell of which words a line holds an odd number, by their hashes
BUCKETS = 1 << 18  # counters of word pairs; what falls into one counts together
SIDE_ROWS = 300_000  # rows of a side that is broadcast; some forty joins of a run pass through one driver
DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"  # written without spaces
WORD = rf"[a-z0-9[\p{{L}}\p{{N}}&&[^{DENSE}]]]+|[\p{{L}}\p{{N}}&&[{DENSE}]]"


def line_words(line: Column) -> Column:
    """The normalised line: its runs of letters and digits in lower case; each letter of a script without spaces is a word."""
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))


def _spread(x: Column, lane: int) -> list[Column]:
    """Every lane-th bit of a 64-bit number, from each of the first `lane` bits on: addends that count bits."""
    mask = sum(1 << k for k in range(0, 64, lane))
    return [F.shiftrightunsigned(x, j).bitwiseAND(F.lit(mask).cast("long")) for j in range(lane)]


def _majority(counts: list[Column], n: Column) -> Column:
    """Bits that more than half of a weight n of numbers have set, from the weighted sums of their spread bits.

    A lane holds as many bits as there are sums; n must leave its top bit free. Adding what a majority lacks to that bit
    shows there whether it is reached.
    """
    lane = len(counts)
    half = sum(1 << k for k in range(0, 32, lane))
    lack = (F.lit((1 << (lane - 1)) - 1).cast("long") - F.floor(n / 2).cast("long")) * F.lit(half).cast("long")
    reached = lambda c: F.shiftright((c + lack).bitwiseAND(F.lit(half << (lane - 1)).cast("long")), lane - 1)
    out = None
    for j, c in enumerate(counts):
        low, high = reached(c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), reached(F.shiftrightunsigned(c, 32))
        bits = F.shiftleft(low.bitwiseOR(F.shiftleft(high, 32)), j)
        out = bits if out is None else out.bitwiseOR(bits)
    return out


def checked(side: DataFrame) -> DataFrame:
    """A narrow side marked for broadcast if a count bounds it; the join shuffles otherwise."""
    return counted(side, SIDE_ROWS)


def weight(word: Column) -> Column:
    """Characters beyond two, at least 1: the short common words of a language hardly move a fingerprint."""
    return F.greatest(F.length(word) - 2, F.lit(1)).cast("long")


def pair_keys(rank: Column, bins: int) -> list[Column]:
    """For each bin of hashes the pair that ranks first; an aggregate over the pairs of a line."""
    return [F.min(F.when(F.pmod(rank, F.lit(bins)) == b, rank)) for b in range(bins)]


def _rank(h: Column, table: DataFrame | None) -> Column:
    """A word pair's place in a common order of all: rarer ones first, those alike in the order of their hashes."""
    low = h.bitwiseAND(F.lit((1 << 56) - 1))
    if table is None:
        return low
    # a literal of that size would be written into every description of the plan, which the driver keeps
    common = F.ascii(F.substring(table.scalar(), F.pmod(h, F.lit(BUCKETS)).cast("int") + 1, F.lit(1)).cast("string"))
    return F.shiftleft(common.cast("long"), 56).bitwiseOR(low)


def fingerprinted(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """doc_id, th (hash of the text) and pos of every line, lh (hash of the normalised line), len in words, chars in them, sim, odd0, .. and keys k0, k1, ..

    Words are taken once: with the next one behind it, each is a row whose spread bits are summed and whose pair is ranked by line,
    which Spark compiles. Lines too long for the sums have wider ones, in a plan of their own if there are any. Texts are dealt out
    before they are cut into lines, so that the sums of a line, several times as wide as its text, need not move.
    """
    usual = F.length("line") < MOST_CHARS
    dealt = lambda df: df.repartition("doc_id", "th")
    out = _summed(_split(dealt(docs)).where(usual), table, LANE)
    longer = docs.where(F.octet_length("text") >= MOST_CHARS)
    if not _split(longer).where(~usual).limit(1).count():
        return out
    return out.unionByName(_summed(_split(dealt(longer)).where(~usual), table, WIDE))


def _split(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _in_turn(rows: DataFrame, *line: str) -> DataFrame:
    """The words w of lines, each with the one behind it, next."""
    # exploding an array of one keeps the words from being taken anew for each use; what is selected beside an explode is
    # worked out for each of its rows, so the hash of the whole line is taken before
    words = rows.select(*line, F.explode(F.array(line_words(F.col("line")))).alias("words"))
    whole = {"lh": F.xxhash64("words"), "len": F.size("words"), "chars": F.length(F.array_join("words", "")).cast("long")} if line else {}
    words = words.select(*line, "words", *[x.alias(c) for c, x in whole.items()])
    turns = words.select(*line, *whole, "words", F.posexplode("words").alias("i", "w"))
    return turns.select(*line, *whole, "w", F.get("words", F.col("i") + 1).alias("next"))


def _odd() -> list[str]:
    return [f"odd{k}" for k in range(PARITY // 64)]


def _parity(h: Column) -> list[Column]:
    """The bit of each hash, in one of several numbers, flipped once for each word; an aggregate over the words of a line."""
    bit = F.expr("shiftleft(1L, cast(h & 63 AS int))")
    return [F.bit_xor(F.when(F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(PARITY // 64 - 1)) == k, bit).otherwise(F.lit(0).cast("long"))) for k in range(PARITY // 64)]


def _summed(rows: DataFrame, table: DataFrame | None, lane: int) -> DataFrame:
    line, whole, keys = ["doc_id", "th", "pos"], ["lh", "len", "chars"], [f"k{b}" for b in range(BINS)]
    words = _in_turn(rows, *line).select(*line, *whole, F.xxhash64("w").alias("h"), weight(F.col("w")).alias("n"),
                                         F.when(F.col("next").isNotNull(), _rank(F.xxhash64("w", "next"), table)).alias("rank"))
    sums = words.groupBy(*line, *whole).agg(F.sum("n").alias("n"), *[c.alias(o) for c, o in zip(_parity(F.col("h")), _odd(), strict=True)],
                                          *[F.sum(c * F.col("n")).alias(f"c{j}") for j, c in enumerate(_spread(F.col("h"), lane))],
                                          *[k.alias(c) for k, c in zip(pair_keys(F.col("rank"), BINS), keys, strict=True)])
    return sums.select(*line, *whole, _majority([F.col(f"c{j}") for j in range(lane)], F.col("n")).alias("sim"), *_odd(), *keys)


def rarity(text: DataFrame) -> bytes:
    """How common word pairs are in all lines of all texts, in counters shared by hash; it only orders keys."""
    pairs = _in_turn(text.select(F.explode(F.split("text", "\n")).alias("line"))).where("next IS NOT NULL")
    pairs = pairs.select(F.pmod(F.xxhash64("w", "next"), F.lit(BUCKETS)).cast("int").alias("b"))
    # printable: 33 and twice the binary logarithm; at most BUCKETS rows of a few bytes come here
    level = F.least(F.lit(90), F.floor(2 * F.log2(F.count(F.lit(1)) + 1))).cast("int") + 33
    out = bytearray([33] * BUCKETS)
    share = pairs.groupBy("b").agg(level.alias("n")).groupBy(F.floor(F.col("b") / 1024).alias("s")).agg(F.collect_list(F.struct("b", "n")).alias("x"))
    for row in share.select(F.concat_ws(",", F.transform("x", lambda v: F.concat_ws(":", v["b"].cast("string"), v["n"].cast("string")))).alias("t")).toLocalIterator():
        for v in row.t.split(","):
            b, n = v.split(":")
            out[int(b)] = int(n)
    return bytes(out)


def one_char_words(codes: Column) -> Column:
    """Each number below 2**20 as one character, so that an edit distance counts words."""
    code = F.transform(codes, lambda c: F.lpad(F.hex(c + F.lit(0x10000).cast("long")), 8, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def pieces(n: int) -> int:
    """Blocks to cut fingerprints into, so that the RADIUS fewer which near ones share tell n lines apart."""
    p = RADIUS + 1
    while 64 * (p - RADIUS) / p < math.log2(n + 1) + 2 and p < 12:
        p += 1
    return p


def block_keys(sim: Column, p: int) -> Column:
    """One key for each choice of p - RADIUS blocks; fingerprints within RADIUS bits have an equal one."""
    at = [64 * i // p for i in range(p + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(p), p - RADIUS)):
        mask = sum(((1 << at[b + 1]) - 1) ^ ((1 << at[b]) - 1) for b in chosen)
        keys.append(F.xxhash64(F.lit(k), sim.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long"))))
    return F.array(*keys)


def _like(similarity: float, bits: int | str) -> str:
    return f"bit_count(a_sim ^ b_sim) <= {bits} AND least(a_len, b_len) >= {similarity} * greatest(a_len, b_len)"


def _candidates(keyed: DataFrame, folder: Folder, name: str, like: str, width: int = SLICE, ranked: str = "") -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of lines (lh, len, sim, keys) that share a key, all pairs but in groups of more than GROUP[name] lines; and those groups' members (key, head, lh).

    Groups of up to three lines follow from sums over the group alone; lines of groups up to GROUP[name] are paired in full, and
    those pairs looked at where they are made; lines of larger groups are paired with the group's first line. No key stands at two
    places of keys, so SLICE places are taken at a time, and only their rows are on disk together. Keys that are
    ranked tell how many lines can share them at most; rows of those that few can share move once, and their pairs must also meet
    the condition `ranked` (on a_odd and b_odd).
    """
    rare = F.shiftrightunsigned("key", 56).between(33, RARE)
    for at in range(0, width, SLICE):
        key = F.explode(F.slice("keys", at + 1, SLICE)).alias("key")
        posted = keyed.select("lh", "len", "sim", key).where("key IS NOT NULL")
        if ranked:
            few = keyed.select("lh", "len", "sim", "odd", key).where("key IS NOT NULL").where(rare)
            folder.put(_in_bounded_groups(few, GROUP[name], f"{like} AND {ranked}"), f"{name}_rare/part{at}")
            posted = posted.where(~rare)
        _in_groups(posted, folder, name, at, like)
        for kind in ("shared", "members"):
            folder.drop(f"{name}_{kind}")
    near, many = folder.all(f"{name}_near", "a long, b long"), folder.all(f"{name}_many", "key long, head long, lh long")
    if ranked:
        found = folder.all(f"{name}_rare", "a long, b long, key long, alike boolean")
        near = near.unionByName(found.where("alike").select("a", "b"))
        many = many.unionByName(found.where("key IS NOT NULL").select("key", F.col("a").alias("head"), F.col("b").alias("lh")))
    return near, many


def _in_bounded_groups(posted: DataFrame, most: int, like: str) -> DataFrame:
    """Pairs (a, b) of the lines of each key that are alike; in groups of more than `most` the first line with each, alike or not, and the key.

    Rows move once, by key; groups are bounded, so a task holds them. Lines that share their key with no other go before others are gathered.
    """
    shared = posted.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("c > 1")
    line = F.struct("lh", "len", "sim", "odd")
    group = shared.groupBy("key", "c").agg(F.collect_list(line).alias("g"), F.min(line).alias("head"))
    firsts = F.when(F.col("c") <= most, F.col("g")).otherwise(F.array("head"))
    pairs = group.select("key", "c", "g", F.explode(firsts).alias("x")).select("key", "c", "x", F.explode("g").alias("y"))
    pairs = pairs.select("key", "c", *[F.col(f"{r}.{f}").alias(f"{s}{t}") for r, s in (("x", "a"), ("y", "b")) for f, t in (("lh", ""), ("len", "_len"), ("sim", "_sim"), ("odd", "_odd"))])
    pairs = pairs.select("a", "b", F.when(F.col("c") > most, F.col("key")).alias("key"), F.expr(f"a < b AND {like}").alias("alike"))
    return pairs.where("key IS NOT NULL OR alike")


def _in_groups(posted: DataFrame, folder: Folder, name: str, at: int, like: str) -> None:
    """Write the pairs and the members of large groups of some keys."""
    shared = folder.put(posted.groupBy("key").agg(F.min("lh").alias("head"), F.max("lh").alias("last"), F.bit_xor("lh").alias("x"),
                                                  F.count(F.lit(1)).alias("c")).where("head <> last"), f"{name}_shared")
    third = F.expr("x ^ head ^ last")
    two = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    few = shared.where("c <= 3").select(F.explode(F.when(F.col("c") == 2, F.array(two(F.col("head"), F.col("last")))).otherwise(
        F.array(two(F.col("head"), F.col("last")), two(F.col("head"), third), two(third, F.col("last"))))).alias("x")).select("x.*")
    members = folder.put(posted.join(checked(shared.where("c > 3").select("key", "head", "c")), "key"), f"{name}_members")
    some, many = members.where(F.col("c") <= GROUP[name]), members.where(F.col("c") > GROUP[name])
    a, b = (some.select("key", F.col("lh").alias(x), F.col("len").alias(f"{x}_len"), F.col("sim").alias(f"{x}_sim")) for x in ("a", "b"))
    inside = a.join(b, "key").where(f"a < b AND {like}").select("a", "b")
    stars = many.where("lh <> head").select(F.col("head").alias("a"), F.col("lh").alias("b"))
    folder.put(few.unionByName(inside).unionByName(stars), f"{name}_near/part{at}")
    folder.put(many.select("key", "head", "lh"), f"{name}_many/part{at}")


def _alike(pairs: DataFrame, long: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs whose lengths and words allow the similarity and whose fingerprints differ in at most the bits that stand beside them.

    A word put in or left out flips one bit of parity, one replaced flips two, so lines as similar as asked for differ in no more
    bits than that; other lines mostly do, and their words are never fetched.
    """
    sides = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits").where("a <> b").groupBy("a", "b").agg(F.max("bits").alias("bits"))
    for x in ("a", "b"):
        sides = sides.join(long.select(F.col("lh").alias(x), *_numbers(x)), x)
    return sides.where(f"{_like(similarity, 'bits')} AND {_few_flips(similarity, _odd())}").select("a", "b")


def _numbers(x: str) -> list[Column]:
    return [F.col(c).alias(f"{x}_{c}") for c in ("len", "sim", *_odd())]


def _folded() -> Column:
    """The parity as 31 bits, for rows that are many: a word still flips one bit or none."""
    x = reduce(lambda a, b: a.bitwiseXOR(b), map(F.col, _odd()))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")


def _few_flips(similarity: float, parity: list[str]) -> str:
    flipped = " + ".join(f"bit_count(a_{c} ^ b_{c})" for c in parity)
    return f"{flipped} <= 2 * {_most(similarity, 'a_len', 'b_len')} - abs(a_len - b_len)"


def _most(similarity: float, a: str, b: str) -> str:
    """The edits that leave lines of so many words as similar as asked for."""
    return f"cast(floor({1 - similarity:.6f} * greatest({a}, {b}) + 0.000001) AS int)"


def _words_of(wanted: DataFrame, lines: DataFrame, text: DataFrame, folder: Folder, name: str) -> DataFrame:
    """lh and hs (hashes of its words, in order) of some lines, taken from one place of each.

    The places are listed by document, so a text is read once for all of its lines and no line moves by itself.
    """
    at = lines.join(checked(wanted), "lh").groupBy("lh").agg(F.min(F.struct("doc_id", "th", "pos")).alias("at"))
    at = at.groupBy(F.col("at.doc_id").alias("_id"), F.col("at.th").alias("_th")).agg(F.collect_list(F.struct(F.col("at.pos").alias("pos"), "lh")).alias("_at"))
    places = folder.put(at, f"{name}_places")
    n = places.agg(F.sum(F.size("_at"))).first()[0] or 0
    side = F.broadcast(places) if n <= SIDE_ROWS else places.hint("shuffle_hash")
    held = text.join(side, F.expr("th = _th AND doc_id <=> _id")).select(F.explode(F.array(F.split("text", "\n"))).alias("all"), "_at")
    said = held.select("all", F.explode("_at").alias("x")).select("x.lh", F.get("all", F.col("x.pos")).alias("line"))
    out = folder.put(said.select("lh", F.transform(line_words(F.col("line")), lambda w: F.xxhash64(w)).alias("hs")), name)
    if out.count() > n:  # rows that repeat id and text
        out = folder.put(out.dropDuplicates(["lh"]), f"{name}_once")
        folder.drop(name)
    folder.drop(f"{name}_places")
    return out


def _numbered(hs: Column, of: Column) -> Column:
    """Places, from 0, of hashes in a sorted array that holds them, by binary search."""
    halves = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    return F.transform(hs, lambda h: F.aggregate(halves, F.lit(0), lambda p, s: F.when(
        F.coalesce(F.get(of, p + s - 1) <= h, F.lit(False)), p + s).otherwise(p)).cast("long") - 1)


def _verified(pairs: DataFrame, words: DataFrame, similarity: float, folder: Folder, name: str) -> DataFrame:
    """The pairs of lines whose edit distance in words is at most 1 - similarity of the longer one.

    Words count as 20 bits of their hash first. Two that fall together can only shorten a distance; so pairs that pass and hold as
    many different words as different codes are settled, and in others words are numbered anew, each its own number.
    """
    both = pairs
    for x in ("a", "b"):
        both = both.join(words.select(F.col("lh").alias(x), F.col("hs").alias(f"{x}_hs")), x)
    most = _most(similarity, "size(a_hs)", "size(b_hs)")
    code = lambda x: F.transform(f"{x}_hs", lambda h: h.bitwiseAND(0xFFFFF))
    said = both.withColumns({"x": one_char_words(code("a")), "y": one_char_words(code("b"))})
    near = folder.put(said.where(F.expr(f"levenshtein(x, y, {most}) >= 0")).select("a", "b", "a_hs", "b_hs"), name)
    # exploding an array of one keeps the numbers from being sorted anew for each word
    near = near.withColumn("u", F.explode(F.array(F.sort_array(F.array_union("a_hs", "b_hs")))))
    number = lambda x: one_char_words(_numbered(F.col(f"{x}_hs"), F.col("u")))
    anew = near.withColumns({"x": number("a"), "y": number("b")})
    settled = F.size("u") == F.size(F.array_union(code("a"), code("b")))
    exact = anew.where(~settled).where(F.expr(f"levenshtein(x, y, {most}) >= 0"))
    return near.where(settled).select("a", "b").unionByName(exact.select("a", "b"))


def _open(many: DataFrame, group: DataFrame) -> DataFrame:
    """The members (key, lh) of large groups that are not in one component yet, each with its component g and the group's size c."""
    of = many.join(checked(group.select(F.col("node").alias("lh"), "component")), "lh", "left").select("key", "lh", F.coalesce("component", "lh").alias("g"))
    apart = of.groupBy("key").agg(F.min("g").alias("first"), F.max("g").alias("last"), F.count(F.lit(1)).alias("c")).where("first <> last")
    return of.join(checked(apart.select("key", "c")), "key")


def _among(open_: DataFrame, long: DataFrame, similarity: float) -> DataFrame:
    """Pairs of lines of a group that are in two components and whose lengths, fingerprints and words allow the similarity."""
    told = open_.join(long.select("lh", "len", "sim", *_odd()), "lh")
    a, b = (told.select("key", F.col("lh").alias(x), F.col("g").alias(f"{x}_g"), *_numbers(x)) for x in ("a", "b"))
    return a.join(b, "key").where(f"a < b AND a_g <> b_g AND {_like(similarity, FAR)} AND {_few_flips(similarity, _odd())}").select("a", "b").distinct()


def _within(open_: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Pairs of lines of a group that are in two components and share a rare word.

    Lines as similar as asked for share one of their 1 + floor((1 - similarity) * n) rarest words, whatever order rare is taken
    in; here it is that of the group, so a template that many lines share brings no two of them together by itself.
    """
    said = open_.join(words, "lh").select("key", "lh", "g", F.size("hs").alias("n"), F.explode(F.array_distinct("hs")).alias("w"))
    common = said.groupBy("key", "w").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    place = F.row_number().over(Window.partitionBy("key", "lh").orderBy(F.coalesce("c", F.lit(1)), "w"))
    first = said.join(common, ["key", "w"], "left").withColumn("place", place).where(
        F.col("c").isNotNull() & (F.col("place") <= 1 + F.floor(F.lit(1 - similarity) * F.col("n") + 0.000001)))
    a, b = (first.select("key", "w", F.col("lh").alias(x), F.col("g").alias(f"{x}_g")) for x in ("a", "b"))
    return a.join(b, ["key", "w"]).where("a < b AND a_g <> b_g").select("a", "b").distinct()


def repeated_lines(docs: DataFrame, folder: Folder, least_words: int = 5, similarity: float = 0.8, least_chars: int = 6) -> DataFrame:
    """doc_id, th (hash of the text) and dropped: the places of lines that repeat a line kept elsewhere or before.

    Lines are normalised, hashed and fingerprinted in one pass. Equal lines are one if they have at least least_words words
    or least_chars letters and digits; only those of least_words words are looked at further. Lines with fingerprints within
    RADIUS bits share a choice of blocks; lines that differ in more bits are looked for by their word pairs, of which each of
    BINS bins gives the rarest. Candidates link if their edit distance in words is at most 1 - similarity of the longer one.
    Lines of a large group that are not connected yet are looked at again by their rarest words within the group.
    Of each connected group the occurrence with the smallest id, and the first there, is kept.
    """
    text = docs.select("doc_id", body().alias("text")).withColumn("th", F.xxhash64("text"))
    table = rarity(text)
    if table is not None:
        table = folder.put(docs.sparkSession.createDataFrame([(table,)], "levels binary"), "rarity")
    lines = folder.put(fingerprinted(text, table).where((F.col("len") >= least_words) | (F.col("chars") >= least_chars)), "lines")
    keys = [f"k{b}" for b in range(BINS)]
    kinds = folder.put(lines.groupBy("lh", "len", "sim").agg(F.count(F.lit(1)).alias("n"), *[F.max(k).alias(k) for k in [*_odd(), *keys]]), "kinds")
    lines = folder.put(lines.select("doc_id", "th", "pos", "lh", "len", "sim"), "spots")
    folder.drop("lines")
    long = kinds.where(F.col("len") >= least_words)
    p = pieces(long.count())
    blocks, crowds = _candidates(long.select("lh", "len", "sim", block_keys(F.col("sim"), p).alias("keys")), folder, "blocks", _like(similarity, LOOSE), math.comb(p, RADIUS))
    pairs, groups = _candidates(long.select("lh", "len", "sim", _folded().alias("odd"), F.array(*keys).alias("keys")), folder, "pairs", _like(similarity, FAR), BINS, _few_flips(similarity, ["odd"]))
    near = blocks.withColumn("bits", F.lit(LOOSE)).unionByName(pairs.withColumn("bits", F.lit(FAR)))
    near = folder.put(_alike(near, long, similarity), "near")
    many = crowds.unionByName(groups)
    hot = many.limit(1).count()
    for name in ("blocks_near", "pairs_near"):
        folder.drop(name)
    words = _words_of(near.select(F.explode(F.array("a", "b")).alias("lh")).distinct(), lines, text, folder, "words")
    links = folder.put(_verified(near, words, similarity, folder, "close"), "links")
    for name in ("close", "near", "words", "words_once"):
        folder.drop(name)
    group = folder.put(components(links, "a", "b", folder), "groups")
    if hot:
        open_ = folder.put(_open(many, group), "open")
        for name in ("blocks_many", "pairs_many", "pairs_rare"):
            folder.drop(name)
        folder.put(_among(open_.where(F.col("c") <= CROWD), long, similarity), "rest/some")
        crowds = open_.where(F.col("c") > CROWD)
        of = long.select("lh", "len")
        n, most = (df.agg(F.sum("len")).first()[0] or 0 for df in (crowds.join(of, "lh"), of))
        if n:
            words = _words_of(crowds.select("lh").distinct(), lines, text, folder, "said")
            passes = -(-n // max(PASS, most // 8))
            for k in range(passes):
                pairs = _within(crowds.where(F.pmod("key", F.lit(passes)) == k), words, similarity)
                folder.put(_alike(pairs.withColumn("bits", F.lit(FAR)), long, similarity), f"rest/part{k}")
            for name in ("said", "said_once"):
                folder.drop(name)
        rest = folder.put(folder.all("rest", "a long, b long").distinct(), "further")
        words = _words_of(rest.select(F.explode(F.array("a", "b")).alias("lh")).distinct(), lines, text, folder, "others")
        links = links.unionByName(folder.put(_verified(rest, words, similarity, folder, "closer"), "more"))
        for name in ("rest", "further", "closer", "open", "others", "others_once"):
            folder.drop(name)
        group = folder.put(components(links, "a", "b", folder, "joined"), "all_groups")
    several = kinds.select("lh", "len", "sim", "n").join(checked(group.withColumnRenamed("node", "lh")), "lh", "left").where("n > 1 OR component IS NOT NULL")
    several = folder.put(several.select("lh", "len", "sim", F.coalesce("component", "lh").alias("g")), "several")
    folder.drop("kinds")
    places = folder.put(lines.join(checked(several), ["lh", "len", "sim"]).select("doc_id", "th", "pos", "g"), "places")
    folder.drop("spots")
    kept = places.groupBy("g").agg(F.min(F.struct("doc_id", "th", "pos")).alias("kept"))
    gone = places.join(checked(kept), "g").where("NOT struct(doc_id, th, pos) <=> kept")
    gone = folder.put(gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("dropped")), "dropped")
    folder.drop("places")
    return gone


def dedup_lines(docs: DataFrame, least_words: int = 5, similarity: float = 0.8, least_chars: int = 6) -> DataFrame:
    """The documents without lines that repeat others, exactly or nearly.

    All columns and rows come back; a text loses the lines named by repeated_lines, and may become empty. Lines end at
    line feeds; lines of fewer than least_words words go only if they repeat a line exactly (after normalisation) and have at
    least least_chars letters and digits. Blank ones and others below that always stay, as they say too little to be a copy.
    Null text stays null, empty text empty. Rows that repeat id and text are one document: both keep the same lines. A
    null id is below all others. Columns that share a name with the operator's own are left as they are.
    """
    folder = Folder(docs.sparkSession, "lines")
    gone = repeated_lines(docs, folder, least_words, similarity, least_chars).select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("dropped").alias("__dropped"))
    small = (gone.agg(F.sum(F.size("__dropped"))).first()[0] or 0) <= SIDE_ROWS
    joined = docs.join(F.broadcast(gone) if small else gone, F.expr("xxhash64(coalesce(text, '')) = __th AND doc_id <=> __id"), "left")
    text = F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(_without(F.col("__dropped")))
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def _without(dropped: Column) -> Column:
    """The text without the lines at some ascending places, in time linear in its lines."""
    before = F.concat(F.array(F.lit(-1)), F.slice(dropped, 1, F.size(dropped) - 1))
    # for each dropped line, as many kept ones as lie before it and after the last
    stays = F.flatten(F.zip_with(dropped, before, lambda x, y: F.concat(F.array_repeat(F.lit(True), x - y - 1), F.array(F.lit(False)))))
    marked = F.arrays_zip(F.split("text", "\n").alias("line"), stays.alias("stays"))
    return F.array_join(F.transform(F.filter(marked, lambda s: F.coalesce(s["stays"], F.lit(True))), lambda s: s["line"]), "\n")
