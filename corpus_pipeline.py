"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of docs; the last one returns
pieces of sequences. A stage's result is written as Parquet and read again as the next one's docs, so a lost
executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodehours.llm.common import Folder, body, checked, parts, table
from nodehours.llm.decontaminate import contaminated
from nodehours.llm.jaccard import jaccard_groups
from nodehours.llm.lines import dedup_lines
from nodehours.llm.packing import pack
from nodehours.llm.toxicity import without_toxic

ORACLE_SQL = None  # fingerprints, learned scores and token ids are beyond SQL


def _keyed(docs: DataFrame, folder: Folder) -> DataFrame:
    """The documents with an integer __key for each (doc_id, text), in the order of ids, null ones last; of rows that repeat both, one stays."""
    th = F.xxhash64(body()).alias("__th")
    order = [F.col("__id").asc_nulls_last(), F.col("__th")]
    ids = docs.select(F.col("doc_id").alias("__id"), th).distinct().repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    ids = folder.put(ids.withColumn("__key", F.monotonically_increasing_id()), "keys")
    rows = docs.join(checked(ids), F.expr("xxhash64(coalesce(text, '')) = __th AND doc_id <=> __id")).select(*[docs[c] for c in docs.columns], "__key")
    return rows if docs.count() == ids.count() else rows.dropDuplicates(["__key"])


def _without(keyed: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The documents whose key is not listed."""
    ids = checked(gone.select(F.col("doc_id").alias("__gone")).distinct())
    return keyed.join(ids, F.col("__key") == F.col("__gone"), "left_anti").select(*[keyed[c] for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return without_toxic(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0, threshold=0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without repeated lines."""
    return dedup_lines(docs, least_words=5, similarity=0.8)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id (a null id is above all others)."""
    folder = Folder(spark, "pipeline")
    keyed = _keyed(docs, folder)
    groups = folder.put(jaccard_groups(keyed.select(F.col("__key").alias("doc_id"), "text"), width=5, percent=80), "groups")
    return _without(keyed, groups.where("doc_id <> component_id"), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; two texts under one id are two documents."""
    folder = Folder(spark, "pipeline")
    keyed = _keyed(docs, folder)
    found = contaminated(keyed.select(F.col("__key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), width=5, least=0.8)
    return _without(keyed, folder.put(found, "found"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=2048, end_id=1)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join),
          ("benchmark decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    folder, docs = Folder(spark, "stages"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = folder.put(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            folder.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
