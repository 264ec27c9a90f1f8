"""Credentials in texts, told apart by how many owners hold the same one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodehours.llm.common import Folder, body, checked

# Patterns of the base kinds, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Runs of 20 or more name characters with a letter and a digit: what a credential outside these forms looks like.
OPAQUE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}"
KINDS = [("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("opaque", OPAQUE, 0)]
LEAST_VALUE = 6  # characters of an assigned value


def _found(kind: int, pattern: str, group: int) -> Column:
    """Matches of one kind in order: the gap before each, its length, and the length and digest of its value."""
    text = F.col("text")
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    rows = F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("k"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("len"),
        F.length(x["value"]).alias("value_len"), F.sha2(x["value"], 256).alias("value")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast(
        "array<struct<kind:int,k:int,gap:int,len:int,value_len:int,value:string>>"))


def scan(docs: DataFrame, owner: str, repository: Sequence[str], max_owners: int = 1) -> DataFrame:
    """Spans of secrets in every text, with the ownership of their values.

    Matches of each kind are leftmost and do not overlap within the kind. The digest of every value is
    counted over the whole corpus: rows are first reduced to distinct (value, owner, repository), then
    counted by value. A value held by at most max_owners owners looks live; one that more owners hold is a copied
    example. Opaque runs that look live and overlap no base span are added as spans of kind "opaque".

    owner is a column of docs, repository the columns that together name one.
    Returns one row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans
    (kind:start:end in code points, end exclusive, by start and then kind, joined by commas), n_live and
    n_example (base spans by ownership), n_opaque (added spans), max_repositories (largest spread of one
    of its values; 0 without spans). Null text is the empty text; null owners or repositories
    are one further owner or repository; texts without a match have no spans and zeros. Repeated rows come
    back repeated, and do not raise the counts of owners. Other columns are ignored.
    """
    folder = Folder(docs.sparkSession, "secrets")
    rows = folder.put(docs.select(
        "doc_id", body().alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]).alias("repo"))
        .select("doc_id", F.xxhash64("text").alias("th"), "owner", "repo",
                F.concat(*[_found(k, p, g) for k, (_, p, g) in enumerate(KINDS)]).alias("found")), "rows")
    hits = rows.where(F.size("found") > 0).select("doc_id", "th", "owner", "repo", F.explode("found").alias("f")).select(
        "doc_id", "th", "owner", "repo", "f.*")
    holders = hits.select("value", "owner", "repo").distinct()
    spread = holders.groupBy("value").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"))

    per_kind = Window.partitionBy("doc_id", "th", "kind").orderBy("k")  # one kind within one text
    before = F.sum(F.col("gap") + F.col("len")).over(per_kind).cast("long")
    spans = (hits.drop("owner", "repo").dropDuplicates(["doc_id", "th", "kind", "k"]).withColumn("end", before)
             .withColumn("start", F.col("end") - F.col("len"))
             .where((F.col("kind") > 0) | (F.col("value_len") >= LEAST_VALUE))
             .join(checked(spread), "value"))
    # furthest end of base spans that start no later, and start of the next base span: an opaque run must lie between
    at = Window.partitionBy("doc_id", "th").orderBy("start", "kind")
    base = F.col("kind") < 3
    reach = F.max(F.when(base, F.col("end"))).over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(base, F.col("start"))).over(at.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    spans = spans.withColumn("reach", F.coalesce(reach, F.lit(0))).withColumn("following", following).where(
        base | ((F.col("owners") <= max_owners) & (F.col("reach") <= F.col("start"))
                & (F.col("following").isNull() | (F.col("following") >= F.col("end")))))
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1)
    said = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("said"))
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x["said"]), ",")
    n = lambda c: F.count(F.when(c, 1))
    per_doc = spans.groupBy("doc_id", "th").agg(
        *[n(F.col("kind") == k).alias(f"n_{KINDS[k][0]}") for k in range(4)],
        F.collect_list(F.when(base, said)).alias("base"), F.collect_list(said).alias("all"),
        n(base & (F.col("owners") <= max_owners)).alias("n_live"), n(base & (F.col("owners") > max_owners)).alias("n_example"),
        F.max("repos").alias("max_repositories"),
    ).withColumn("base", joined("base")).withColumn("all", joined("all")).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    out = rows.select("doc_id", "th").join(per_doc, F.expr("th = _th AND doc_id <=> _id"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("all", F.lit("")).alias("spans"),
        zero("n_live"), zero("n_example"), zero("n_opaque"), zero("max_repositories"))
