"""Trace sources: landing tables (raw rows) to typed tables, and typed tables from parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodehours.functions import clean as C

# Job attributes taken from the raw JSON text.
TOP_FIELDS = ["eligible_time", "etime", "depend", "Hold_Types", "run_count", "Priority"]
RESOURCE_NUMBERS = ["base_score", "score_boost", "project_priority", "enable_wfp", "enable_fifo",
                    "enable_backfill", "wfp_factor", "fifo_factor", "backfill_factor", "backfill_max",
                    "burn_ratio", "total_allocation", "current_allocation"]
RESOURCE_TEXTS = ["award_category"]


def read_landing(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A landing table in any Spark format; CSV / JSON need a schema to avoid inference."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path or None)


def jobs_from_raw(raw: DataFrame) -> DataFrame:
    """Finished jobs with a size and a submission time, raw attributes typed."""
    kept = raw.where((F.col("state") == "FINISHED") & (F.col("nodes") > 0) & F.col("submit_time").isNotNull())
    df = C.json_fields(kept, "raw_pbs_data", plain=TOP_FIELDS,
                       nested={"Resource_List": RESOURCE_NUMBERS + RESOURCE_TEXTS}, present={"has_depend": "depend"})
    start, end, submit = (C.ts_lenient(c) for c in ("start_time", "end_time", "submit_time"))
    text = ["owner", "project", "allocation_type", "queue", "state"]
    return df.select(
        F.col("job_id").cast("string").alias("job_id"), *[F.col(c).cast("string").alias(c) for c in text],
        F.col("nodes").cast("int").alias("nodes"),
        submit.alias("submit_time"), start.alias("start_time"), end.alias("end_time"),
        C.ts_weekday("etime").alias("eligible_time_ts"), "exit_status", "has_depend",
        F.col("Hold_Types").alias("hold_types"),
        C.number("run_count").alias("run_count"), C.number("Priority").alias("pbs_priority"),
        C.hms_hours("walltime").alias("walltime_h"), C.hms_hours("eligible_time").alias("eligible_h"),
        (F.col("actual_runtime_seconds") / 3600.0).alias("runtime_h"),
        C.wait_hours("queue_time_seconds", start, submit).alias("wait_h"),
        *[C.number(c).alias(c) for c in RESOURCE_NUMBERS], *RESOURCE_TEXTS)


def reservations_from_raw(raw: DataFrame) -> DataFrame:
    cols = ["reservation_id", "reservation_name", "owner", "state", "queue"]
    return raw.select(*cols, F.coalesce(C.number("nodes").cast("int"), F.lit(0)).alias("nodes"),
                      C.ts_lenient("start_time").alias("start_time"), C.ts_lenient("end_time").alias("end_time"),
                      "duration_seconds")


QUEUE_JSON = """queue_type string, enabled string, started string, Priority string,
 resources_max struct<nodect: string, walltime: string>, resources_min struct<nodect: string, walltime: string>,
 resources_default struct<base_score: string, enable_wfp: string, enable_fifo: string, enable_backfill: string>,
 max_run_res struct<nodect: string>, max_run string, max_queued string, from_route_only string,
 route_destinations string"""


def queues_from_raw(raw: DataFrame) -> DataFrame:
    """Nested queue definition text to one flat row of limits; an absent limit is NULL."""
    j = F.col("j")

    def flag(name: str, default: str) -> Column:
        return F.lower(F.coalesce(j[name], F.lit(default))) == "true"

    numbers = {
        "min_nodes": C.number(j["resources_min"]["nodect"]), "max_nodes": C.number(j["resources_max"]["nodect"]),
        "min_walltime_h": C.hms_hours(j["resources_min"]["walltime"]),
        "max_walltime_h": C.hms_hours(j["resources_max"]["walltime"]),
        "max_run_per_user": C.parse_limit(j["max_run"], "u"), "max_run_per_project": C.parse_limit(j["max_run"], "p"),
        "max_queued_per_user": C.parse_limit(j["max_queued"], "u"),
        "max_queued_per_project": C.parse_limit(j["max_queued"], "p"),
        "max_nodes_total": C.parse_limit(j["max_run_res"]["nodect"], "o"),
    }
    numbers |= {c: C.number(j["resources_default"][c])
                for c in ("base_score", "enable_wfp", "enable_fifo", "enable_backfill")}
    return raw.withColumn("j", F.from_json("raw_pbs_data", QUEUE_JSON)).select(
        "name", F.coalesce(j["queue_type"], F.col("queue_type")).alias("queue_type"),
        flag("enabled", "True").alias("enabled"), flag("started", "True").alias("started"),
        F.coalesce(C.number(j["Priority"]), F.lit(0.0)).alias("queue_priority"),
        *[c.alias(n) for n, c in numbers.items()],
        flag("from_route_only", "False").alias("from_route_only"),
        F.coalesce(j["route_destinations"], F.lit("")).alias("route_destinations"))


def snapshots_from_raw(raw: DataFrame) -> DataFrame:
    return C.state_counts(raw.withColumn("timestamp", C.ts_lenient("timestamp")))


def read_jobs(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    return jobs_from_raw(read_landing(spark, path, fmt, schema, **options))


def read_reservations(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    return reservations_from_raw(read_landing(spark, path, fmt, schema, **options))


def read_queues(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    return queues_from_raw(read_landing(spark, path, fmt, schema, **options))


def read_snapshots(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    return snapshots_from_raw(read_landing(spark, path, fmt, schema, **options))


TRACE_TABLES = ("jobs", "reservations", "queues", "node_availability")


def load_trace(spark: SparkSession, directory: str) -> dict[str, DataFrame | None]:
    """The extracted tables of one trace; node availability may be absent (None)."""
    out: dict[str, DataFrame | None] = {}
    for name in TRACE_TABLES:
        try:
            out[name] = spark.read.parquet(f"{directory}/{name}.parquet")
        except AnalysisException as err:
            if name != "node_availability" or err.getCondition() != "PATH_NOT_FOUND":
                raise
            out[name] = None
    return out
