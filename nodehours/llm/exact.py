"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodehours.llm.common import BROADCAST_DIGESTS, Folder, body, checked


def _named(rows: DataFrame, cols: list[str], folder: Folder, level: int) -> DataFrame:
    """Distinct values of cols, sorted in parts, each with one integer name.

    Equal values meet in one part by their hash, are one row before they move, and are told apart by the sort itself. Parts cut
    by ranges would need samples of the values, whole blocks of text, in the driver. The table is written before it is
    used: a lost executor cannot rename anything.
    """
    values = rows.select(*cols).distinct().sortWithinPartitions(*cols)
    return folder.put(values.withColumn("name", F.monotonically_increasing_id()), f"names{level}")


def exact_groups(docs: DataFrame, block_chars: int = 4096) -> DataFrame:
    """Groups of rows with identical text.

    Texts are cut into blocks of block_chars characters. Equal blocks get the same integer name by
    sorting the blocks themselves; then the names of adjacent blocks are paired and named in the same
    way until each text has one name. Names stand for whole contents, so nothing can collide. A text
    with a block (or hash of one) that occurs nowhere else equals no other text; it is settled before
    contents are moved, so only blocks that may be shared are shuffled.

    Returns one row per input row: doc_id, keep_id (largest doc_id of the group), group_size, kept,
    text_sha256. Null text is the empty text, which has one empty block. Repeated rows each count and
    each come back; those with the largest doc_id are kept. A null doc_id is below all others. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = Folder(spark, "exact")
    text = docs.select(F.col("doc_id"), body().alias("text"))
    blocks = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    text = text.withColumn("sha", F.sha2("text", 256))
    hashed = folder.put(
        text.select("doc_id", "sha", F.transform(blocks, lambda b: F.xxhash64(b)).alias("hs"))
        .select("doc_id", "sha", F.size("hs").alias("n"), F.posexplode("hs").alias("i", "h")), "hashed")
    shared = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    rows = hashed.where("i = 0").groupBy("doc_id", "sha", "n").agg(F.count(F.lit(1)).alias("m"))
    # texts all of whose blocks occur again somewhere
    open_ = (hashed.dropDuplicates(["doc_id", "sha", "i"]).join(checked(shared), "h").groupBy("doc_id", "sha", "n")
             .agg(F.count(F.lit(1)).alias("c")).where("c = n").select("doc_id", "sha"))
    open_ = folder.put(rows.alias("r").join(open_.alias("o"), F.expr("r.sha = o.sha AND r.doc_id <=> o.doc_id"))
                       .select("r.*"), "open")
    longest = open_.agg(F.max("n")).first()[0] or 0

    pieces = (text.join(checked(open_.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")), BROADCAST_DIGESTS),
                        F.expr("sha = _sha AND doc_id <=> _id"), "left_semi")
              .select("doc_id", "sha", F.posexplode(blocks).alias("i", "block")).dropDuplicates(["doc_id", "sha", "i"]))
    names = _named(pieces, ["block"], folder, 0)
    level = folder.put(pieces.join(names, "block").select("doc_id", "sha", "i", "name"), "level0")
    k = 0
    while longest > 1:
        k, longest = k + 1, (longest + 1) // 2
        even = F.col("i") % 2 == 0
        pairs = (level.groupBy("doc_id", "sha", F.expr("CAST(floor(i / 2) AS INT)").alias("j"))
                 .agg(F.max(F.when(even, F.col("name"))).alias("a"),
                      F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1).cast("long")).alias("b"))
                 .withColumnRenamed("j", "i"))
        pairs = folder.put(pairs, f"pairs{k}")
        names = _named(pairs, ["a", "b"], folder, k)
        level = folder.put(pairs.join(names, ["a", "b"]).select("doc_id", "sha", "i", "name"), f"level{k}")
        folder.drop(f"level{k - 1}")
        folder.drop(f"pairs{k}")
    members = level.select("doc_id", "sha", "name").join(
        open_.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), "m"), F.expr("sha = _sha AND doc_id <=> _id"))
    groups = members.groupBy("name").agg(F.max("doc_id").alias("keep_id"), F.sum("m").alias("group_size"))
    shared = folder.put(members.join(checked(groups.where("group_size > 1")), "name").select("_id", "_sha", "keep_id", "group_size"), "groups")
    out = hashed.where("i = 0").select("doc_id", "sha").join(shared, F.expr("sha = _sha AND doc_id <=> _id"), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
