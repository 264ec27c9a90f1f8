"""Result tables: sinks, fall-back reads, profile table, resume and upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodehours.blocks import join_on, stored
from nodehours.functions import clean as C
from nodehours.functions.constants import PROGRAM_MAP, SIZE_TIERS

PART = "_part"  # folder column of tables in parts by key
PROFILE_VERSION = 1
PROFILE_COLUMNS = ["job_id", "program", "project", "nodes", "walltime_h", "rt_ratio", "runtime_h", "cal_month"]


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> str:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).csv(path, header=True)
    return path


def read_results(spark: SparkSession, parquet: str, csv: str, schema: str) -> DataFrame:
    """The parquet result table, or the CSV one where that does not exist; successful runs only."""
    try:
        df = spark.read.schema(schema).parquet(parquet)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.read.schema(schema).csv(csv, header=True)
    return df.where(F.col("status") == "OK")


def fit_input(raw: DataFrame, min_runtime_s: float = 30, programs=PROGRAM_MAP, tiers=SIZE_TIERS) -> DataFrame:
    """Finished jobs with a usable runtime and a mapped program, walltime repaired, tier and month attached."""
    df = raw.where((F.col("state") == "FINISHED") & (F.col("nodes") > 0)
                   & (F.col("actual_runtime_seconds") >= min_runtime_s) & F.col("submit_time").isNotNull())
    df = df.withColumn("program", C.map_values("allocation_type", programs, None)).where(F.col("program").isNotNull())
    df = df.withColumn("submit_time", C.ts_lenient("submit_time")).where(F.col("submit_time").isNotNull())
    run = F.col("actual_runtime_seconds") / 3600.0
    wall = C.repaired_walltime(C.hms_hours("walltime", two_part=True), run)
    return df.select("job_id", "program", "project", "submit_time", F.col("nodes").cast("int").alias("nodes"),
                     wall.alias("walltime_h"), run.alias("runtime_h"), C.runtime_ratio(run, wall).alias("rt_ratio"),
                     F.month("submit_time").alias("cal_month"), C.size_tier("nodes", tiers).alias("size_tier"))


def write_profile(fit: DataFrame, path: str, min_runtime_s: float = 30) -> str:
    """Narrow profile table plus one metadata row (version, span of the trace, runtime floor)."""
    span = C.hours_since(F.max("submit_time"), F.min("submit_time"))
    meta = fit.agg(F.lit(PROFILE_VERSION).alias("version"), span.alias("span_h"),
                   F.lit(float(min_runtime_s)).alias("min_runtime_s"))
    fit.select(*PROFILE_COLUMNS).write.parquet(f"{path}/rows")
    meta.write.parquet(f"{path}/meta")
    return path


def read_profile(spark: SparkSession, path: str, tiers=SIZE_TIERS) -> tuple[DataFrame, float]:
    """Profile rows with their tier, and the span in hours; another version is rejected."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta.version != PROFILE_VERSION:
        raise ValueError(f"profile version {meta.version} != expected {PROFILE_VERSION}")
    rows = spark.read.parquet(f"{path}/rows").withColumn("size_tier", C.size_tier("nodes", tiers))
    return rows, meta.span_h


def pending(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks whose key is not stored yet."""
    return join_on(tasks, done.select(*keys), keys, "left_anti")


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row concatenation; columns absent on one side become NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def upsert(prev: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keyed upsert, last write wins: new over previous, then the highest ``order``.

    Rows of a table have no order of their own, so at least one column must say which was written last.

    One aggregation with map-side combine, no window over the rows of a key.
    """
    if not order:
        raise ValueError("name the columns that tell the last write")
    both = prev.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in {*keys, "_gen"}]
    rank = F.struct("_gen", *order, *[c for c in rest if c not in order])
    row = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return row.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def last_writes(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the highest ``order``; ties fall to the highest other columns.

    Only rank 1 is wanted, so Spark keeps one row per key and task before anything moves.
    """
    if not order:
        raise ValueError("name the columns that tell the last write")
    rest = [c for c in rows.columns if c not in {*keys, *order}]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in [*order, *rest]])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def part_of(keys: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias(PART)


def write_parts(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], parts: int) -> str:
    """A keyed table in folders by hash of its key, one row per key; give parts of a size that one task can write."""
    one = last_writes(rows, keys, order)
    one.select("*", part_of(keys, parts)).repartition(PART).write.partitionBy(PART).parquet(path)
    return path


def upsert_parts(new: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], parts: int) -> int:
    """Upsert into a table of write_parts; only the folders that new rows fall into are read and replaced.

    As in upsert, new rows go over stored ones, and among them the highest ``order`` wins. Stored rows are neither sorted nor
    aggregated: those whose key is not written anew stay. Columns absent in the new rows become NULL, others must be the table's.
    The replaced folders are written beside the old ones and swapped when all tasks have ended, so a lost executor costs its
    tasks alone. Use the number of parts that the table was written with. Returns how many folders were replaced.
    """
    spark = new.sparkSession
    now = stored(last_writes(new, keys, order).select("*", part_of(keys, parts)))
    hit = sorted(r[0] for r in now.select(PART).distinct().collect())  # at most as many numbers as parts
    if not hit:
        return 0
    old = spark.read.parquet(path)
    if extra := set(now.columns) - set(old.columns):
        raise ValueError(f"the table has no columns {sorted(extra)}")
    stays = join_on(old.where(F.col(PART).isin(hit)), now.select(PART, *keys), [PART, *keys], "left_anti")
    both = stays.unionByName(now, allowMissingColumns=True).repartition(PART)
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return len(hit)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)
