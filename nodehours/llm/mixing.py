"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodehours.blocks import join_on, numbered, running
from nodehours.llm.common import BROADCAST_DIGESTS, Folder, body, checked, parts

BLOCK_ROWS = 200_000  # documents whose sizes are summed in order by one task
SORTED_ROWS = 500_000  # queued rows of a range
WORD = "[^\\x20\\x09-\\x0D]++"


def _sources(sized: DataFrame, weights: Sequence[int], most: int, folder: Folder) -> DataFrame:
    """source, source_size, rank (code points, null last), w, m (time of a word) and cap (words it can give)."""
    sums = folder.put(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sums")
    named = numbered(sums.where("source IS NOT NULL"), [], "source", name="rank")
    null = sums.where("source IS NULL").withColumn("rank", F.lit(sums.count()).cast("long"))
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    out = named.unionByName(null).withColumn("w", w).withColumn("m", F.floor(F.lit(math.lcm(*weights)) / F.col("w")).cast("long"))
    return folder.put(out.withColumn("cap", most * F.col("source_size")), "sources")


def _levels(sources: DataFrame, unit: int, budget: int) -> tuple[int, int, int]:
    """Words given by the sources that run dry, the last time one does, and the weight of the others, once the budget is met.

    A source gives w words of every unit of time until it has given cap; times are kept as whole words times m.
    """
    giving = sources.where("cap > 0").withColumn("last", F.col("cap") * F.col("m"))
    weight = giving.agg(F.sum("w")).first()[0] or 0
    dry = running(giving.groupBy("last").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w")), [], "last", {"given": ("sum", "cap"), "v": ("sum", "w")})
    big = "cast({} AS decimal(38,0))"
    within = f"{big.format('given')} * {unit} + {big.format(f'({weight} - v)')} * last <= {big.format(budget)} * {unit}"
    r = dry.where(F.expr(within)).agg(F.max(F.struct("last", "given", "v")).alias("r")).first().r
    return (0, 0, weight) if r is None else (r["given"], r["last"], weight - r["v"])


def _spans(most: int) -> list[Column]:
    """For each copy of a document, how many words of its source come before it."""
    return [F.lit(k) * F.col("source_size") + F.col("before") for k in range(most)]


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, budget: int | None = None, seed: str = "",
        folder: Folder | None = None) -> DataFrame:
    """How much of each document a mixture of the sources takes.

    Returns doc_id, th (hash of the text), size in words, source_size, target (of its source, in words), taken (words the
    mixture takes, repeats counted), and finishes (virtual finish time of each copy of which it takes anything, and the words).

    Sources, in the order of their code points and null last, weigh weights, repeating. Documents of a source are shuffled by a
    hash of id, seed and text and queue up most times over; a copy's virtual finish time is the source's words up to its
    end, divided by the weight. All copies are range-sorted by it (then by source) and the budget, by default all words of
    the table, is cut off there. A source that runs dry leaves the rest of the budget to the others by weight: that
    is what the targets say. Copies that the cut can fall into are queued word by word, so that a source misses its target
    by a few words only, however long its documents are.

    Nothing depends on partitioning: reruns agree. Null text has no words, and documents without words are not taken; rows
    that repeat id and text stand in the queue each; a null id is below all others; columns other than doc_id, text and source are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or Folder(spark, "mix")
    unit = math.lcm(*weights)
    shuffled = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}|"), F.md5(body()))), 1, 15), 16, 10).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(body()).alias("th"),
                       F.regexp_count(body(), F.lit(WORD)).cast("long").alias("size"), shuffled.alias("h"))
    sized = folder.put(rows, "sized")
    n, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    budget = total if budget is None else budget
    sources = _sources(sized, weights, most, folder)
    given, last, weight = _levels(sources, unit, budget)
    left = max(0, budget - given)
    target = F.when(F.col("cap") * F.col("m") <= last, F.col("cap").cast("double")).otherwise(
        F.col("w").cast("double") * F.lit(float(left)) / F.lit(float(max(weight, 1))))

    # words of the source before each document, in blocks of the shuffled order
    block = F.floor(F.col("h") / F.lit(float(1 << 60) / max(1, -(-n // BLOCK_ROWS)))).cast("int")
    sized = sized.withColumn("block", block)
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.groupBy("source", "block").agg(F.sum("size").alias("z")).select(
        "source", "block", F.coalesce(F.sum("z").over(earlier), F.lit(0)).alias("offset"))
    offsets = folder.put(join_on(offsets, checked(sources.withColumn("target", target), BROADCAST_DIGESTS), ["source"]), "offsets")
    within = Window.partitionBy("source", "block").orderBy("h", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    queue = join_on(sized, checked(offsets, BROADCAST_DIGESTS), ["source", "block"]).select(
        "doc_id", "th", "size", "source_size", "target", "rank", "m", before.alias("before"))
    queue = folder.put(queue, "queue")
    folder.drop("sized")

    # every word that finishes by `sure` fits the budget, and no word after `sure + unit` is reached
    sure = left * unit // weight if weight else last
    items = []
    for s in _spans(most):
        end = s + F.col("size")
        done = F.least(end, F.expr(f"{sure} div m"))
        reach = F.least(end, F.expr(f"{sure + unit} div m"))
        whole = F.when(done > s, F.array(F.struct((done * F.col("m")).alias("finish"), (done - s).alias("words"))))
        single = F.when(reach > F.greatest(done, s), F.transform(F.sequence(F.greatest(done, s) + 1, reach), lambda p: F.struct(
            (p * F.col("m")).alias("finish"), F.lit(1).cast("long").alias("words"))))
        items += [F.coalesce(x, F.array().cast("array<struct<finish:bigint,words:bigint>>")) for x in (whole, single)]
    items = queue.where("size > 0").select("rank", F.explode(F.concat(*items)).alias("x")).select("x.*", "rank")
    ranges = max(parts(spark), -(-most * n // SORTED_ROWS))
    order = folder.put(items.repartitionByRange(ranges, "finish", "rank").sortWithinPartitions("finish", "rank").withColumn(
        "range", F.spark_partition_id()), "order")
    sums = sorted((r["range"], r.words) for r in order.groupBy("range").agg(F.sum("words").alias("words")).collect())  # one row a range
    before_range, cut = 0, None
    for at, words in sums:
        if before_range + words >= budget:
            cut = at
            break
        before_range += words
    if cut is None:  # the budget is more than all copies have
        end, end_rank = (1 << 62), 0
    else:
        so_far = F.sum("words").over(Window.partitionBy("range").orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        r = order.where(F.col("range") == cut).withColumn("so_far", so_far + before_range).where(F.col("so_far") <= budget).agg(
            F.max(F.struct("finish", "rank")).alias("r")).first().r
        end, end_rank = (0, 0) if r is None else (r["finish"], r["rank"])
    folder.drop("order")

    upto = F.when(F.col("rank") <= end_rank, F.expr(f"{end} div m")).otherwise(F.expr(f"{max(end - 1, 0)} div m"))
    took = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), upto - s)) for s in _spans(most)]
    copies = F.filter(F.array(*[F.struct(((s + F.col("size")) * F.col("m") / F.lit(float(unit))).alias("finish"), t.alias("words"))
                                for s, t in zip(_spans(most), took, strict=True)]), lambda x: x["words"] > 0)
    return queue.select("doc_id", "th", "size", "source_size", "target", sum(took[1:], took[0]).alias("taken"), copies.alias("finishes"))


def stream(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixture itself, in order: all columns of docs, copy_finish and copy_words (of a copy, its first words are taken).

    Of rows that repeat id and text, the first stands for all, and is taken as often as they are.
    """
    plan = mixed.where("taken > 0").groupBy("doc_id", "th").agg(F.flatten(F.collect_list("finishes")).alias("__all"))
    plan = plan.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "__all")
    rows = docs.withColumn("__key", F.xxhash64(body())).dropDuplicates(["doc_id", "__key"])
    out = rows.join(plan, F.expr("__key = __th AND doc_id <=> __id")).withColumn("__copy", F.explode("__all"))
    out = out.select(*[out[c] for c in docs.columns], F.col("__copy.finish").alias("copy_finish"), F.col("__copy.words").alias("copy_words"))
    return out.orderBy("copy_finish", "doc_id")
