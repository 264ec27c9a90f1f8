"""Bounded samples of labelled training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodehours.llm.common import body, checked, fold


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int, per_class: bool = False) -> DataFrame:
    """doc_id, text and y of at most `most` labelled rows outside the held-out fold (of each class, if per_class).

    Rows are taken in the order of a hash of their id, so the same rows train whatever the partitioning. Null labels and
    ids are left out; an id labelled more than once counts once, as 1 if any label is 1. Of rows with the same text one is kept.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(modulus) != held))
             .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(label))
    if per_class:
        known = known.where("y = 1").orderBy(order, "doc_id").limit(most).unionByName(known.where("y = 0").orderBy(order, "doc_id").limit(most))
    else:
        known = known.orderBy(order, "doc_id").limit(most)
    known = checked(known.withColumnsRenamed({"doc_id": "_id"}))
    return docs.select("doc_id", body().alias("text")).join(known, F.col("doc_id") == F.col("_id")).drop("_id").dropDuplicates(["text"])
