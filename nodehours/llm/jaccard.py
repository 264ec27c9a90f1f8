"""Documents with nearly the same word shingles, by T-occurrence search."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodehours.llm.common import Folder, body, checked
from nodehours.llm.components import components
from nodehours.llm.tally import BUCKET_KEYS, Block, answers_of, arrow_kind, counted, encoded
from nodehours.llm.words import MIX, mixed

SHARD = 2_000_000  # shingles searched together, about
PROBE = 1.0  # cost of probing against merging, which sets how many lists may be long
LONG = 64  # documents a long list has at least
COARSE = np.uint64(16)  # low bits of a shingle's hash that are left out when documents are counted


class Shingles:
    """Distinct shingles of each text of a block: 64-bit hashes, ascending, each with its texts ascending."""

    def __init__(self, b: Block, width: int) -> None:
        h = b.vocabulary[b.codes] if len(b.codes) else np.zeros(0, np.uint64)
        length = np.diff(b.offsets)
        rolled, doc = h.copy(), np.repeat(np.arange(len(length), dtype=np.int32), length)
        for k in range(1, width):
            rolled[:len(h) - k] = mixed(rolled[:len(h) - k] * MIX + h[k:])
        place = np.arange(len(h)) - np.repeat(b.offsets[:-1], length)
        whole = place + width <= np.repeat(length, length)
        short = np.flatnonzero((length > 0) & (length < width))  # one shingle of all their words
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            more = length[short] > k
            at = b.offsets[short[more]] + k
            extra[more] = mixed(extra[more] * MIX + h[at] + length[short[more]].astype(np.uint64))
        key, doc = np.concatenate([rolled[whole], extra]), np.concatenate([doc[whole], short.astype(np.int32)])
        order = np.lexsort((doc, key)) if len(short) else np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        self.key, self.doc, self.texts = key[once], doc[once], len(length)
        coarse = self.key >> COARSE << COARSE
        new = np.ones(len(coarse), bool)
        new[1:] = coarse[1:] != coarse[:-1]
        self.coarse, self.number = coarse[new], np.cumsum(new, dtype=np.int32) - 1

    def asks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.coarse, np.bincount(self.number, minlength=len(self.coarse)))]


def divide_skip(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that occur in at least `need` of the sorted lists numbers[start:end], ascending, and in how many they occur.

    The longest lists are only probed, by bisection, for numbers that the others leave a chance. The others are merged
    by counting, all at once: a number must occur in `need` of them less the long ones to go on.
    """
    if need < 1 or len(starts) < need:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = ends - starts
    order = np.argsort(length, kind="stable")
    n_long = min(need - 1, int(need / (PROBE * math.log2(int(length[order[-1]]) + 1) + 1)), int((length > LONG).sum()))
    short, long = order[:len(order) - n_long], order[len(order) - n_long:]
    n = length[short]
    at = np.repeat(starts[short] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    count = np.bincount(numbers[at])
    values = np.flatnonzero(count >= need - n_long)
    count = count[values]
    for k, x in enumerate(long.tolist()):
        if not len(values):
            break
        one = numbers[starts[x]:ends[x]]
        count = count + (one[np.minimum(np.searchsorted(one, values), len(one) - 1)] == values)
        may = count + (n_long - k - 1) >= need
        values, count = values[may], count[may]
    return values, count


def search(ids: list[int], sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect all linked sets given here; sets on different sides are matched across only.

    Each set is a query for all sets of fitting size, unless they are connected to it already. Sets whose shingles
    are the commonest come first, and a set that one of them has found does not ask by itself: most
    groups are near copies of one text. Then all sets outside the largest group ask, which covers every pair of groups.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    sides, size = np.array([side[i] for i in order]), np.array([len(s) for s in sets])
    across = len(set(side)) > 1
    # inverted lists of all shingles, the list of each shingle of each set, and how common a set's shingles are
    shingle, number = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    by = np.lexsort((number, shingle))
    numbers, new = number[by], np.append(True, np.diff(shingle[by]) != 0)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(numbers))
    of = np.empty(len(shingle), np.int64)
    of[by] = np.cumsum(new) - 1
    base = np.concatenate([[0], np.cumsum(size)])
    common = np.bincount(number, (ends - starts)[of], len(sets)) / size
    root, links = np.arange(len(ids)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def ask(q: int) -> None:
        need = -(-percent * int(size[q]) // 100)
        low, high = np.searchsorted(size, [need, 100 * int(size[q]) // percent + 1])
        mine, free = top(q), sides[low:high] != sides[q] if across else True
        if not ((root[low:high] != mine) & free).any():  # all there is, is connected
            return
        lists = of[base[q]:base[q + 1]]
        lists = lists[ends[lists] - starts[lists] > 1]
        for d, shared in zip(*(x.tolist() for x in divide_skip(numbers, starts[lists], ends[lists], need)), strict=True):
            if not low <= d < high or (across and sides[d] == sides[q]) or (r := top(d)) == mine:
                continue
            if 100 * shared >= percent * (size[q] + size[d] - shared):
                links.append((ids[d], ids[q]))
                root[r] = mine

    for q in np.argsort(-common, kind="stable").tolist():
        if root[q] == q:
            ask(q)
    groups = [top(q) for q in range(len(ids))]
    largest = Counter(groups).most_common(1)[0][0]
    for q in range(len(ids)):
        if groups[q] != largest:
            ask(q)
    return links


def jaccard_groups(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Groups of documents connected by links of Jaccard similarity percent / 100 or more.

    1. Shingles are counted over the corpus, block by block (see tally). In the order of how many documents have them,
       rare ones first, two linked documents share one of the first n - ceil(percent n / 100) + 1 of either.
       Those that no other document has are no use there, so most documents have none left and are settled.
    2. Documents with equal sets are one class from here on, named by their smallest id. Classes that share such a
       shingle are brought together by its smallest holder; components of these candidates hold every pair
       that can be linked.
    3. Candidates' sets are dealt to shards by component. A component beyond SHARD shingles is cut into blocks, and
       each pair of blocks is a shard. A shard builds inverted lists and asks one T-occurrence query per set.
    4. Links that connect what belongs together (not all pairs) are joined to components.

    Returns one row per input row: doc_id, n_shingles, component_id. Without words a document has no shingles and is
    alone. Null text is empty. A null id joins no group by itself and takes that of equal sets; rows that repeat an id
    are one document. Other columns are ignored; an empty table gives no rows. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    folder = Folder(spark, "jaccard")
    kind, arrow = dict(docs.dtypes)["doc_id"], arrow_kind(docs, "doc_id")
    blocks = encoded(docs.select("doc_id", body().alias("text"), F.lit(0).alias("part"), F.lit(0).alias("mark")), folder)
    buckets = 1 + (blocks.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_KEYS
    answers = counted(blocks, lambda b: Shingles(b, width).asks(), [buckets],
                      lambda sums, parts: (sums.sum(0, keepdims=True).astype("<u8"), []), folder)

    def settle(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = blocks.to_pylist()
        b = Block(row)
        s = Shingles(b, width)
        holders = answers_of(answers, 0, buckets, "<u8", 1)[0].astype(np.int64)[s.number]
        n = np.bincount(s.doc, minlength=s.texts)
        first = n - -(-percent * n // 100) + (n > 0)
        alone = np.bincount(s.doc[holders == 1], minlength=s.texts)
        open_ = first > alone  # the first ones hold some that another document may have
        mine = open_[s.doc]
        key, doc, holders = s.key[mine], s.doc[mine], holders[mine]
        by_doc, by_rank = np.argsort(doc, kind="stable"), np.lexsort((key, holders, doc))
        cut = np.searchsorted(doc[by_doc], np.arange(s.texts + 1))
        elements, keys, digest = [None] * s.texts, [None] * s.texts, [None] * s.texts
        for i in np.flatnonzero(open_).tolist():
            raw = key[by_doc[cut[i]:cut[i + 1]]].tobytes()
            elements[i], digest[i] = raw, hashlib.blake2b(raw, digest_size=16).digest()
            keys[i] = key[by_rank[cut[i] + alone[i]:cut[i] + first[i]]].view(np.int64)
        return pa.table({"doc_id": pa.array(b.ids, arrow), "n": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary()),
                         "keys": pa.array(keys, pa.list_(pa.int64())), "elements": pa.array(elements, pa.binary())})

    sets = folder.put(blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(
        settle, f"doc_id {kind}, n long, digest binary, keys array<long>, elements binary"), "sets")
    folder.drop("blocks")
    folder.drop("answers")
    open_ = sets.where("digest IS NOT NULL")
    several = folder.put(open_.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
                         .where("copies > 1 AND rep IS NOT NULL"), "several")
    copies = (open_.select("doc_id", "digest").join(checked(several), "digest")
              .where("NOT doc_id <=> rep").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")))
    members = open_.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long")).join(
        checked(copies), F.expr("doc_id = _id AND digest = _digest"), "left_anti")
    posted = members.select("doc_id", F.explode("keys").alias("key"))
    heads = folder.put(posted.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail"))
                       .where("head < tail").select("key", "head"), "heads")
    near = components(posted.join(checked(heads), "key").where("doc_id > head").select("doc_id", "head").distinct(), "doc_id", "head", folder, "near")
    near = folder.put(near, "candidates")

    weight = near.join(members.groupBy(F.col("doc_id").alias("node")).agg(F.max("n").alias("n")), "node")
    heavy = folder.put(weight.groupBy("component").agg(F.sum("n").alias("n")), "weights")
    shards = max(1, math.ceil((heavy.agg(F.sum("n")).first()[0] or 0) / SHARD))
    cuts = F.when(F.col("n") > SHARD, F.ceil(F.col("n") * 2 / F.lit(SHARD))).otherwise(1).cast("int")
    placed = near.join(checked(heavy.select("component", cuts.alias("blocks"))), "component")
    # a pair of blocks (s, t), s <= t, is a shard of its own; components in one block share shards
    placed = placed.withColumn("s", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn(
        "t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "component", F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"),
        F.when(F.col("s") <= F.col("t"), 0).otherwise(1).alias("side"),
        F.when(F.col("blocks") > 1, F.xxhash64("component", F.least("s", "t"), F.greatest("s", "t")))
        .otherwise(F.pmod(F.xxhash64("component"), F.lit(shards))).alias("shard"))

    def shard(table: pa.Table) -> pa.Table:
        groups: dict[tuple, list[dict]] = {}
        for r in table.to_pylist():
            groups.setdefault((r["component"], r["lo"], r["hi"]), []).append(r)
        out = []
        for rows in groups.values():
            out += search([r["doc_id"] for r in rows], [np.frombuffer(r["elements"], np.uint64) for r in rows], [r["side"] for r in rows], percent)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    links = (members.select("doc_id", "elements").join(checked(placed), F.expr("doc_id = node"))
             .select("doc_id", "elements", "component", "lo", "hi", "side", "shard").groupBy("shard").applyInArrow(shard, "a long, b long"))
    linked = folder.put(components(folder.put(links, "links"), "a", "b", folder, "linked"), "groups")
    # the component of a class, where it differs from the document itself
    named = (open_.select("doc_id", "digest").join(checked(linked), F.col("doc_id").cast("long") == F.col("node"))
             .groupBy("digest").agg(F.min("component").alias("component")))
    of_digest = folder.put(several.select("digest", "rep").join(named, "digest", "full").select(
        F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("component")), "of_digest")
    return sets.select("doc_id", "n", "digest").join(checked(of_digest), F.col("digest") == F.col("_digest"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
