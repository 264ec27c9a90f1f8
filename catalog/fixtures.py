"""The given tables seen as a job trace, in Spark and as SQL views with the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodehours.functions import clean as C
from nodehours.blocks import scratch_dir

T0 = "2024-01-01"
T1 = 720.0  # hours of the observation window

PROGRAM_DIM = [("A", 0.50, 1, 0.25), ("B", 0.25, 7, 0.0), ("C", 0.10, 1, None)]  # share, start month, overburn
QUEUE_DIM = [  # name, min/max nodes, walltime cap, routable, running per user and project, node limit, queued per user and project
    ("click", 1, 1024, 6.0, True, 3, 8, 60000, 2, 6), ("error", 1, 4096, 2.0, True, 4, 12, 90000, 3, 10),
    ("purchase", 513, 2048, 12.0, True, 3, 9, 70000, None, 7), ("signup", 1025, 4096, 24.0, True, 2, 10, None, 1, 8),
    ("view", 1, 10624, 24.0, False, None, 15, 80000, 4, None)]
BREAKPOINTS = [(1, 4.0), (512, 8.0), (1920, 24.0)]
DEADLINES = [("d1", 48.0, 96.0, 2.0), ("d2", 240.0, 360.0, 1.5), ("d3", 336.0, 400.0, 3.0)]


def prop_k():
    """The integer of props, whose text is always {"k": <int>}."""
    return F.substring_index(F.substring_index("props", ": ", -1), "}", 1).cast("int")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = prop_k()
    eid, uid = F.col("event_id"), F.col("user_id")
    submit = C.hours_since("ts", T0)
    run = F.col("value") / 60.0
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    df = e.select(
        eid.alias("job_id"), F.col("event_type").alias("queue"), uid.alias("user"),
        F.concat(F.lit("p"), (uid % 23).cast("string")).alias("project"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (uid % 3 + 1).cast("int")).alias("program"),
        (1 + (eid * 7919) % 4096).cast("int").alias("nodes"), "ts", k.alias("k"), "value",
        submit.alias("submit_h"), run.alias("runtime_h"),
        F.greatest(run * (1 + 0.5 * (eid % 4)), F.lit(0.1)).alias("walltime_h"),
        F.when(eid % 37 != 0, k).alias("queue_time"),
        F.concat_ws(":", F.lpad(F.floor("value").cast("string"), 3, "0"), two(eid % 60), two(uid % 60)).alias("walltime_hms"),
        F.date_format("ts", "EEE MMM dd HH:mm:ss yyyy").alias("etime_txt"),
        F.concat(F.lit("[u:GENERIC="), k.cast("string"), F.lit("][p:GENERIC="), (2 * k).cast("string"), F.lit("]")).alias("limit_txt"),
        (1 + (eid % 50 == 0).cast("int")).alias("run_count"), (eid % 7 == 0).alias("has_depend"),
        (F.col("value") / 60.0).alias("other_wait_h"),
        F.lit(51.0).alias("base_score"), (eid % 3).cast("double").alias("score_boost"),
        F.element_at(F.array(F.lit(25.0), F.lit(20.0), F.lit(2.0)), (uid % 3 + 1).cast("int")).alias("project_priority"),
        (F.col("event_type") != "error").cast("double").alias("enable_wfp"),
        (F.col("event_type") == "error").cast("double").alias("enable_fifo"),
        (F.col("event_type") == "signup").cast("double").alias("enable_backfill"),
        F.lit(100000.0).alias("wfp_factor"), F.lit(1800.0).alias("fifo_factor"),
        F.lit(84600.0).alias("backfill_factor"), F.lit(50.0).alias("backfill_max"))
    df = df.withColumn("start_h", F.col("submit_h") + F.col("k") / 4.0)
    return df.withColumn("end_h", F.col("start_h") + F.col("runtime_h")).withColumn("wait_h", F.col("start_h") - F.col("submit_h"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of the window with starts after its end unknown (never started)."""
    df = jobs(spark, sf)
    ok = F.col("start_h") < T1
    return df.withColumns({c: F.when(ok, F.col(c)) for c in ("start_h", "end_h", "wait_h")}).withColumn(
        "size_tier", C.size_tier("nodes", tiers()))


def tiers():
    from nodehours.functions.constants import SIZE_TIERS

    return SIZE_TIERS


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type") == "error")
    return e.select(F.col("ts").alias("timestamp"),
                    F.translate(F.upper(F.md5(F.col("event_id").cast("string"))), "0123456789CDF", "EEEEAAALBIEAL").alias("snapshot_data"))


def usable(spark: SparkSession, sf: str) -> DataFrame:
    """Usable-node step series in hours; the 32 letters stand for 32 blocks of 332 nodes."""
    c = C.state_counts(snapshots(spark, sf))
    return c.select(C.hours_since("timestamp", T0).alias("t_h"), (F.col("up_nodes") * 332.0).alias("up"))


def reservations(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type") == "signup")
    k = prop_k()
    start = C.hours_since("ts", T0)
    return e.where(k < 5).select(
        F.col("event_id").alias("reservation_id"), start.alias("start_h"), (start + F.col("value") / 10.0).alias("end_h"),
        (256 * (1 + F.col("user_id") % 8)).cast("int").alias("nodes"),
        F.when(F.col("event_id") % 11 == 0, "CANCELLED").otherwise("COMPLETED").alias("state"))


def completed(spark: SparkSession, sf: str) -> DataFrame:
    return reservations(spark, sf).where(F.col("state") == "COMPLETED")


def queues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUEUE_DIM, "name string, min_nodes int, max_nodes int, max_walltime_h double, "
                                 "routable boolean, max_run_per_user int, max_run_per_project int, max_nodes_total int, "
                                 "max_queued_per_user int, max_queued_per_project int")


def programs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROGRAM_DIM, "program string, target_share double, start_month int, overburn double")


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Run results: six configurations by seven seeds, metrics reduced from lineitem."""
    li = table(spark, sf, "lineitem")
    from nodehours.operators.quantiles import quantiles

    li = li.withColumn("config_hash", F.substring(F.md5(F.concat("l_returnflag", "l_linestatus")), 1, 12))
    keys = ["config_hash", "l_linenumber", "l_returnflag", "l_linestatus"]
    avg = li.groupBy(*keys).agg(F.round(F.avg("l_discount"), 8).alias("m_avg"), F.count(F.lit(1)).alias("m_n"),
                                F.sum(F.when(F.col("l_quantity") > 25, 1).otherwise(0)).alias("m_big"))
    p95 = quantiles(li, keys, "l_quantity", {"m_p95": 0.95})
    return avg.join(p95, keys).select(
        "config_hash", F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("param_a"),
        F.col("l_linestatus").alias("param_b"), "m_avg", "m_p95", F.col("m_n").cast("double").alias("m_n"),
        F.col("m_big").cast("double").alias("m_big"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"), "SATURATED").otherwise("OK").alias("status"))


def order_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """A multi-year trace from orders; some months are thin, light or absent."""
    o = table(spark, sf, "orders")
    key, m = F.col("o_orderkey"), F.month("o_orderdate")
    month = (F.when((m == 3) & (key % 10 < 8), 2).when((m == 11) & (F.col("o_orderstatus") == "P"), 12).otherwise(m))
    run = F.col("o_totalprice") / 100000.0 * F.when(month.isin(6, 7), 0.1).otherwise(1.0)
    df = o.select(key.alias("job_id"), F.translate("o_orderstatus", "FOP", "ABC").alias("program"),
                  F.concat(F.lit("p"), (F.col("o_custkey") % 37).cast("string")).alias("project"),
                  F.col("o_orderdate").alias("submit_time"), (1 + (F.col("o_custkey") * 7919) % 4096).cast("int").alias("nodes"),
                  run.alias("runtime_h"), (run * (1 + 0.5 * (key % 4))).alias("walltime_h"), month.cast("int").alias("cal_month"))
    return df.withColumns({"rt_ratio": C.runtime_ratio("runtime_h", "walltime_h"), "size_tier": C.size_tier("nodes", tiers())})


def big_intervals(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    start = C.hours_since("l_shipdate", "1995-01-01") + F.col("l_linenumber")
    return li.select(start.alias("start_h"), (start + F.col("l_quantity")).alias("end_h"),
                     (1 + F.col("l_partkey") % 4096).alias("nodes"), "l_returnflag")


def _num(v) -> str:
    return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else
                                     (f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)))


def values_sql(rows, cols: str) -> str:
    body = ", ".join("(" + ", ".join(_num(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({cols})"


TIER_CASE = ("CASE WHEN nodes <= 128 THEN 'capacity' WHEN nodes <= 512 THEN 'small' "
             "WHEN nodes <= 2048 THEN 'medium' ELSE 'large' END")

CTES = {
    "jobs_fx": """
SELECT *, submit_h + k / 4.0::DOUBLE AS start_h, submit_h + k / 4.0::DOUBLE + runtime_h AS end_h,
  (submit_h + k / 4.0::DOUBLE) - submit_h AS wait_h
FROM (SELECT event_id AS job_id, event_type AS queue, user_id AS "user", 'p' || (user_id % 23)::VARCHAR AS project,
  CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS program,
  (1 + (event_id * 7919) % 4096)::INTEGER AS nodes, ts, json_extract_string(props, '$.k')::INTEGER AS k, value,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE AS submit_h, value / 60.0::DOUBLE AS runtime_h,
  greatest((value / 60.0::DOUBLE) * (1 + 0.5::DOUBLE * (event_id % 4)), 0.1::DOUBLE) AS walltime_h,
  CASE WHEN event_id % 37 <> 0 THEN json_extract_string(props, '$.k')::INTEGER END AS queue_time,
  lpad(floor(value)::BIGINT::VARCHAR, 3, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') || ':' || lpad((user_id % 60)::VARCHAR, 2, '0') AS walltime_hms,
  strftime(ts, '%a %b %d %H:%M:%S %Y') AS etime_txt,
  (1 + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END)::INTEGER AS run_count, event_id % 7 = 0 AS has_depend,
  value / 60.0::DOUBLE AS other_wait_h, 51.0::DOUBLE AS base_score, (event_id % 3)::DOUBLE AS score_boost,
  CASE user_id % 3 WHEN 0 THEN 25.0 WHEN 1 THEN 20.0 ELSE 2.0 END::DOUBLE AS project_priority,
  (event_type <> 'error')::INT::DOUBLE AS enable_wfp, (event_type = 'error')::INT::DOUBLE AS enable_fifo,
  (event_type = 'signup')::INT::DOUBLE AS enable_backfill FROM events)""",
    "runs_fx": f"""
SELECT * EXCLUDE (start_h, end_h, wait_h), CASE WHEN start_h < 720 THEN start_h END AS start_h,
  CASE WHEN start_h < 720 THEN end_h END AS end_h, CASE WHEN start_h < 720 THEN wait_h END AS wait_h,
  {TIER_CASE} AS size_tier FROM jobs_fx""",
    "snapshots_fx": """
SELECT ts AS timestamp, translate(upper(md5(event_id::VARCHAR)), '0123456789CDF', 'EEEEAAALBIEAL') AS snapshot_data
FROM events WHERE event_type = 'error'""",
    "counts_fx": """
SELECT timestamp, 32 AS n, (32 - length(replace(snapshot_data, 'E', '')))::INTEGER AS busy_nodes,
  (32 - length(replace(snapshot_data, 'A', '')))::INTEGER AS free_nodes,
  (32 - length(replace(snapshot_data, 'L', '')))::INTEGER AS resv_nodes FROM snapshots_fx""",
    "usable_fx": """
SELECT (epoch_us(timestamp) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE AS t_h,
  (busy_nodes + free_nodes) * 332.0::DOUBLE AS up FROM counts_fx""",
    "resv_fx": """
SELECT event_id AS reservation_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE AS start_h,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE + value / 10.0::DOUBLE AS end_h,
  (256 * (1 + user_id % 8))::INTEGER AS nodes,
  CASE WHEN event_id % 11 = 0 THEN 'CANCELLED' ELSE 'COMPLETED' END AS state
FROM events WHERE event_type = 'signup' AND json_extract_string(props, '$.k')::INTEGER < 5""",
    "queues_fx": values_sql(QUEUE_DIM, "name, min_nodes, max_nodes, max_walltime_h, routable, max_run_per_user, max_run_per_project, max_nodes_total, max_queued_per_user, max_queued_per_project"),
    "programs_fx": values_sql(PROGRAM_DIM, "program, target_share, start_month, overburn"),
    "deadlines_fx": values_sql(DEADLINES, "name, s, e, mult"),
    "breakpoints_fx": values_sql(BREAKPOINTS, "min_nodes, cap"),
    "results_fx": """
SELECT substr(md5(l_returnflag || l_linestatus), 1, 12) AS config_hash, l_linenumber AS seed, l_returnflag AS param_a,
  l_linestatus AS param_b, round(avg(l_discount), 8) AS m_avg, quantile_cont(l_quantity, 0.95) AS m_p95, count(*)::DOUBLE AS m_n,
  sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::DOUBLE AS m_big,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'SATURATED' ELSE 'OK' END AS status
FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber""",
    "big_fx": """
SELECT (epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1995-01-01')) / 3.6e9::DOUBLE + l_linenumber AS start_h,
  (epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1995-01-01')) / 3.6e9::DOUBLE + l_linenumber + l_quantity AS end_h,
  1 + l_partkey % 4096 AS nodes, l_returnflag FROM lineitem""",
    "resvok_fx": "SELECT * FROM resv_fx WHERE state = 'COMPLETED'",
    "avail_fx": """
SELECT t_h, up, reserved, greatest(0.0, least(least(up, 10624.0), 10624.0 - reserved)) AS available FROM (
 SELECT p.t_h, coalesce(u.up, (SELECT arg_min(up, t_h) FROM usable_fx)) AS up,
  coalesce((SELECT sum(nodes) FROM resvok_fx r WHERE r.start_h <= p.t_h AND p.t_h < r.end_h), 0)::DOUBLE AS reserved
 FROM (SELECT t_h FROM usable_fx UNION SELECT start_h FROM resvok_fx UNION SELECT end_h FROM resvok_fx) p
 ASOF LEFT JOIN usable_fx u ON p.t_h >= u.t_h)""",
    "running_fx": "SELECT *, greatest(start_h + walltime_h, 360.0::DOUBLE + 1e-9::DOUBLE) AS req_end FROM jobs_fx WHERE start_h <= 360 AND end_h > 360",
    "profile_fx": """
SELECT p.t_h, floor(a.available - coalesce((SELECT sum(nodes) FROM running_fx r WHERE r.req_end > p.t_h), 0) + 1e-9::DOUBLE) AS free
FROM (SELECT req_end AS t_h FROM running_fx WHERE req_end < 420 UNION SELECT t_h FROM avail_fx WHERE t_h > 360 AND t_h < 420
 UNION SELECT 360.0::DOUBLE UNION SELECT 420.0::DOUBLE) p ASOF LEFT JOIN avail_fx a ON p.t_h >= a.t_h""",
    "quarters_fx": "SELECT range AS bin, range * 0.25::DOUBLE AS t_h FROM range(2880)",
    "conc_fx": """
SELECT q.bin, q.t_h, q.busy, coalesce((SELECT sum(nodes) FROM resvok_fx r WHERE r.start_h <= q.t_h AND q.t_h < r.end_h), 0)::DOUBLE AS reserved
FROM (SELECT g.bin, g.t_h, coalesce(sum(j.nodes * (least(j.end_h, g.t_h + 0.25) - greatest(j.start_h, g.t_h))), 0) / 0.25::DOUBLE AS busy
 FROM quarters_fx g LEFT JOIN jobs_fx j ON j.start_h < g.t_h + 0.25 AND j.end_h > g.t_h GROUP BY g.bin, g.t_h) q""",
    "ordjobs_fx": f"""
SELECT *, {TIER_CASE} AS size_tier, least(greatest(runtime_h / walltime_h, 0.001), 1.0) AS rt_ratio FROM (
SELECT job_id, program, project, submit_time, nodes, cal_month, rt AS runtime_h, rt * (1 + 0.5::DOUBLE * (job_id % 4)) AS walltime_h FROM (
SELECT *, price / 100000.0::DOUBLE * CASE WHEN cal_month IN (6, 7) THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS rt FROM (
SELECT o_orderkey AS job_id, translate(o_orderstatus, 'FOP', 'ABC') AS program, 'p' || (o_custkey % 37)::VARCHAR AS project, o_orderdate AS submit_time,
 (1 + (o_custkey * 7919) % 4096)::INTEGER AS nodes, o_totalprice AS price,
 (CASE WHEN month(o_orderdate) = 3 AND o_orderkey % 10 < 8 THEN 2 WHEN month(o_orderdate) = 11 AND o_orderstatus = 'P' THEN 12 ELSE month(o_orderdate) END)::INTEGER AS cal_month FROM orders)))""",
    "offs_fx": "SELECT j.*, ((cal_month - start_month + 12) % 12)::INTEGER AS alloc_off, start_month FROM ordjobs_fx j JOIN programs_fx USING (program)",
    "hours_fx": "SELECT range AS bin, range * 1.0::DOUBLE AS t_h FROM range(721)",
}
