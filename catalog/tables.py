"""Sources and sinks (S) and row concatenation (K4)."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import query, rnd
from nodehours.functions.constants import PROGRAM_MAP
from nodehours.operators import experiments as E
from nodehours.sources import tables as B
from nodehours.sources import trace as S


def raw_jobs(s, d):
    """Landing rows: text timestamps, text walltime and one JSON text of attributes."""
    j = X.jobs(s, d)
    fmt = "yyyy-MM-dd HH:mm:ss"
    sub = F.date_trunc("second", F.col("ts").cast("timestamp_ntz"))
    res = {"base_score": F.col("base_score"), "score_boost": F.col("score_boost"), "project_priority": F.when(F.col("job_id") % 9 != 0, F.col("project_priority")),
           "enable_wfp": F.col("enable_wfp"), "award_category": F.col("program")}
    js = F.struct(F.col("walltime_hms").alias("eligible_time"), F.col("etime_txt").alias("etime"),
                  F.when(F.col("has_depend"), F.lit("afterok:1")).alias("depend"), F.lit("n").alias("Hold_Types"),
                  F.col("run_count").cast("string").alias("run_count"), F.col("k").alias("Priority"),
                  F.struct(*[c.cast("string").alias(n) for n, c in res.items()]).alias("Resource_List"))
    names = list(PROGRAM_MAP)
    alloc = F.when(F.col("job_id") % 10 == 0, "Staff").otherwise(
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("user") % 3 + 1).cast("int")))
    run_s = F.floor(F.col("value") * 60)
    return j.select("job_id", F.col("user").cast("string").alias("owner"), "project", alloc.alias("allocation_type"), "queue",
                    F.when(F.col("job_id") % 41 != 0, F.col("nodes")).alias("nodes"), F.col("walltime_hms").alias("walltime"),
                    F.date_format(sub, fmt).alias("submit_time"), F.date_format(F.timestamp_add("MINUTE", F.col("k") * 15, sub), fmt).alias("start_time"),
                    F.when(F.col("job_id") % 13 == 0, "?").otherwise(F.date_format(F.timestamp_add("MINUTE", F.col("k") * 16, sub), fmt)).alias("end_time"),
                    run_s.alias("actual_runtime_seconds"), F.when(F.col("job_id") % 37 != 0, F.col("k") * 900).alias("queue_time_seconds"),
                    F.lit(0).alias("exit_status"), F.when(F.col("job_id") % 17 == 0, "QUEUED").otherwise("FINISHED").alias("state"),
                    F.to_json(js).alias("raw_pbs_data"))


RAW = """
raw AS (SELECT *, date_trunc('second', ts) AS sub FROM jobs_fx WHERE job_id % 17 <> 0 AND job_id % 41 <> 0)"""


@query("s1_read_jobs", f"""WITH {RAW.strip()}
SELECT job_id::VARCHAR AS job_id, nodes, sub AS submit_time, sub + INTERVAL (k * 15) MINUTE AS start_time, CASE WHEN job_id % 13 <> 0 THEN sub + INTERVAL (k * 16) MINUTE END AS end_time,
 sub AS eligible_time_ts, has_depend, run_count::DOUBLE AS run_count, k::DOUBLE AS pbs_priority,
 round(split_part(walltime_hms,':',1)::DOUBLE + split_part(walltime_hms,':',2)::DOUBLE/60 + split_part(walltime_hms,':',3)::DOUBLE/3600, 7) AS walltime_h,
 round(floor(value * 60) / 3600, 7) AS runtime_h, k / 4.0::DOUBLE AS wait_h, CASE WHEN job_id % 9 <> 0 THEN project_priority END AS project_priority, program AS award_category, NULL::DOUBLE AS backfill_max FROM raw""")
def _(s, d):
    path = B.write_table(raw_jobs(s, d), X.new_path(s, "raw_jobs"))
    t = S.read_jobs(s, path)
    cols = ["job_id", "nodes", "submit_time", "start_time", "end_time", "eligible_time_ts", "has_depend", "run_count", "pbs_priority",
            "walltime_h", "runtime_h", "wait_h", "project_priority", "award_category", "backfill_max"]
    return rnd(t.select(*cols), 7)


@query("s1_read_jobs_json", f"WITH {RAW.strip()} SELECT queue, count(*) AS n, sum(nodes)::BIGINT AS nodes, count(*) FILTER (WHERE has_depend) AS n_depend FROM raw GROUP BY queue")
def _(s, d):
    raw = raw_jobs(s, d)
    path = X.new_path(s, "raw_jobs_json")
    raw.write.json(path)
    ddl = ", ".join(f"{c} {t}" for c, t in raw.dtypes)
    t = S.read_jobs(s, path, "json", ddl)
    return t.groupBy("queue").agg(F.count("*").alias("n"), F.sum("nodes").alias("nodes"), F.count_if("has_depend").alias("n_depend"))


@query("s2_read_reservations", """
SELECT event_id AS reservation_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END::INTEGER AS nodes, date_trunc('second', ts) AS start_time,
 CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) + INTERVAL 2 HOUR END AS end_time FROM events WHERE event_type = 'signup'""")
def _(s, d):
    e = X.table(s, d, "events").where(F.col("event_type") == "signup")
    fmt, t0 = "yyyy-MM-dd HH:mm:ss", F.date_trunc("second", F.col("ts"))
    raw = e.select(F.col("event_id").alias("reservation_id"), F.lit("m").alias("reservation_name"), F.lit("o").alias("owner"), F.lit("RN").alias("state"),
                   F.lit("R1").alias("queue"), F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string")).otherwise("n/a").alias("nodes"),
                   F.date_format(t0, fmt).alias("start_time"),
                   F.when(F.col("event_id") % 5 == 0, "never").otherwise(F.date_format(F.timestamp_add("HOUR", F.lit(2), t0), fmt)).alias("end_time"),
                   F.lit(7200).alias("duration_seconds"))
    path = X.new_path(s, "raw_resv")
    raw.write.csv(path, header=True)
    ddl = ", ".join(f"{c} {t}" for c, t in raw.dtypes)
    return S.read_reservations(s, path, "csv", ddl, header=True).select("reservation_id", "nodes", "start_time", "end_time")


@query("s3_read_queues", """
SELECT 'u' || user_id AS name, 'Execution' AS queue_type, user_id % 2 = 0 AS enabled, TRUE AS started, (count(*) % 5)::DOUBLE AS queue_priority, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 16 END::DOUBLE AS min_nodes,
 max(event_id)::DOUBLE AS max_nodes, 24.5::DOUBLE AS max_walltime_h, (user_id % 7)::DOUBLE AS max_run_per_user, count(*)::DOUBLE AS max_run_per_project, NULL::DOUBLE AS max_queued_per_user,
 4096.0::DOUBLE AS max_nodes_total, 51.0::DOUBLE AS base_score, NULL::DOUBLE AS enable_wfp, user_id % 4 = 0 AS from_route_only FROM events GROUP BY user_id""")
def _(s, d):
    e = X.table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("mx"))
    u = F.col("user_id")
    txt = lambda c: c.cast("string")
    js = F.struct(
        F.lit("Execution").alias("queue_type"), F.when(u % 2 == 0, "True").otherwise("False").alias("enabled"), txt(F.col("n") % 5).alias("Priority"),
        F.struct(txt(F.col("mx")).alias("nodect"), F.lit("24:30:00").alias("walltime")).alias("resources_max"),
        F.when(u % 3 != 0, F.struct(F.lit("16").alias("nodect"))).alias("resources_min"),
        F.struct(F.lit("51").alias("base_score")).alias("resources_default"), F.struct(F.lit("[o:PBS_ALL=4096]").alias("nodect")).alias("max_run_res"),
        F.concat(F.lit("[u:PBS_GENERIC="), txt(u % 7), F.lit("][p:PBS_GENERIC="), txt(F.col("n")), F.lit("]")).alias("max_run"),
        F.when(u % 4 == 0, "True").alias("from_route_only"))
    raw = e.select(F.concat(F.lit("u"), txt(u)).alias("name"), F.lit("?").alias("queue_type"), F.lit(True).alias("is_active"), F.to_json(js).alias("raw_pbs_data"))
    t = S.read_queues(s, B.write_table(raw, X.new_path(s, "raw_queues")))
    return t.select("name", "queue_type", "enabled", "started", "queue_priority", "min_nodes", "max_nodes", "max_walltime_h", "max_run_per_user",
                    "max_run_per_project", "max_queued_per_user", "max_nodes_total", "base_score", "enable_wfp", "from_route_only")


@query("s4_read_snapshots", "SELECT date_trunc('second', timestamp) AS timestamp, n, busy_nodes, free_nodes, resv_nodes FROM counts_fx")
def _(s, d):
    raw = X.snapshots(s, d).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    bad = raw.limit(1).select(F.lit("no time").alias("timestamp"), "snapshot_data").unionByName(raw.limit(1).select("timestamp", F.lit("").alias("snapshot_data")))
    t = S.read_snapshots(s, B.write_table(raw.unionByName(bad), X.new_path(s, "raw_snap")))
    return t.select("timestamp", "n", "busy_nodes", "free_nodes", "resv_nodes")


@query("s5_load_trace", """
SELECT 'jobs' AS name, count(*) AS n FROM jobs_fx UNION ALL SELECT 'reservations', count(*) FROM resv_fx UNION ALL SELECT 'queues', count(*) FROM queues_fx UNION ALL SELECT 'node_availability', NULL""")
def _(s, d):
    path = X.new_path(s, "trace")
    for name, df in (("jobs", X.jobs(s, d)), ("reservations", X.reservations(s, d)), ("queues", X.queues(s))):
        B.write_table(df, f"{path}/{name}.parquet")
    out = None
    for name, df in S.load_trace(s, path).items():
        one = s.range(1).select(F.lit(name).alias("name"), F.lit(None).cast("long").alias("n")) if df is None else df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s6_write_table", "SELECT job_id, queue, nodes FROM jobs_fx")
def _(s, d):
    path = B.write_table(X.jobs(s, d).select("job_id", "queue", "nodes"), X.new_path(s, "jobs"), partition_by=["queue"])
    return s.read.parquet(path)


@query("s7_write_csv", "SELECT queue, count(*) AS n, sum(nodes)::BIGINT AS nodes FROM jobs_fx GROUP BY queue")
def _(s, d):
    t = X.jobs(s, d).groupBy("queue").agg(F.count("*").alias("n"), F.sum("nodes").alias("nodes"))
    return s.read.schema("queue string, n long, nodes long").csv(B.write_csv(t, X.new_path(s, "csv")), header=True)


@query("s8_read_results", "SELECT config_hash, seed, m_p95 FROM results_fx WHERE status = 'OK'")
def _(s, d):
    t = X.results(s, d).select("config_hash", "seed", "m_p95", "status")
    path = B.write_csv(t, X.new_path(s, "results_csv"))
    return B.read_results(s, path + "-none", path, "config_hash string, seed int, m_p95 double, status string").drop("status")


FIT = """
rj AS (SELECT *, floor(value * 60) AS rs, split_part(walltime_hms,':',1)::DOUBLE + split_part(walltime_hms,':',2)::DOUBLE/60 + split_part(walltime_hms,':',3)::DOUBLE/3600 AS w FROM jobs_fx WHERE job_id % 17 <> 0 AND job_id % 41 <> 0 AND job_id % 10 <> 0),
ft AS (SELECT *, CASE "user" % 3 WHEN 0 THEN 'INCITE' WHEN 1 THEN 'ALCC' ELSE 'DD' END AS prog, rs / 3600 AS rh, CASE WHEN w < rs / 3600 THEN greatest(rs / 3600 * 1.5, 0.1) ELSE w END AS wh FROM rj WHERE rs >= 30)"""


@query("s10_profile", f"""WITH {FIT.strip()}
SELECT prog AS program, project, {X.TIER_CASE} AS size_tier, month(ts)::INTEGER AS cal_month, count(*) AS n, sum(nodes)::BIGINT AS nodes, round(sum(rh), 5) AS runtime_h,
 round((SELECT (epoch_us(max(date_trunc('second', ts))) - epoch_us(min(date_trunc('second', ts)))) / 3.6e9::DOUBLE FROM ft), 6) AS span_h FROM ft GROUP BY ALL""")
def _(s, d):
    path = B.write_profile(B.fit_input(raw_jobs(s, d)), X.new_path(s, "profile"))
    rows, span = B.read_profile(s, path)
    return rows.groupBy("program", "project", "size_tier", "cal_month").agg(
        F.count("*").alias("n"), F.sum("nodes").alias("nodes"), F.round(F.sum("runtime_h"), 5).alias("runtime_h"), F.round(F.lit(span), 6).alias("span_h"))


@query("s11_fit_input", f"""WITH {FIT.strip()}
SELECT job_id, prog AS program, nodes, round(wh, 7) AS walltime_h, round(rh, 7) AS runtime_h, round(least(greatest(rh / wh, 0.001), 1), 7) AS rt_ratio, month(ts)::INTEGER AS cal_month, {X.TIER_CASE} AS size_tier FROM ft""")
def _(s, d):
    return rnd(B.fit_input(raw_jobs(s, d)).drop("project", "submit_time"), 7)


@query("s12_resume_append", """
WITH t AS (SELECT a, b, range AS seed FROM (SELECT DISTINCT l_returnflag AS a, l_linestatus AS b FROM lineitem), range(7)),
done AS (SELECT DISTINCT l_returnflag AS a, l_linestatus AS b, l_linenumber AS seed FROM lineitem WHERE l_linenumber > 2)
SELECT a AS l_returnflag, b AS l_linestatus, seed::INTEGER AS seed, 'done' AS state FROM done UNION ALL
SELECT a, b, seed, 'new' FROM t WHERE NOT EXISTS (SELECT 1 FROM done x WHERE x.a = t.a AND x.b = t.b AND x.seed = t.seed)""")
def _(s, d):
    li = X.table(s, d, "lineitem")
    todo = E.tasks(li.select("l_returnflag", "l_linestatus").distinct(), 7, 0).drop("config_hash")
    done = li.where(F.col("l_linenumber") > 2).select("l_returnflag", "l_linestatus", F.col("l_linenumber").alias("seed")).distinct()
    path = B.write_table(done.withColumn("state", F.lit("done")), X.new_path(s, "runs"))
    new = B.pending(todo, s.read.parquet(path), ["l_returnflag", "l_linestatus", "seed"]).withColumn("state", F.lit("new"))
    B.write_table(new, path, mode="append")
    return s.read.parquet(path)


UPSERTED = """
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_partkey AS p, 0 AS gen FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT l_orderkey, l_linenumber, -l_quantity, l_partkey, 1 FROM lineitem WHERE l_returnflag <> 'N')
SELECT l_orderkey, l_linenumber, q, p FROM a QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY gen DESC, p DESC, q DESC) = 1"""


@query("s13_upsert", UPSERTED)
def _(s, d):
    prev, new, cols = writes(s, d)
    return B.upsert(prev, new, cols, order=["p"])


@query("s13_upsert_parts", UPSERTED)
def _(s, d):
    prev, new, cols = writes(s, d)
    path = B.write_parts(prev, X.new_path(s, "parts"), cols, ["p"], 16)
    B.upsert_parts(new, path, cols, ["p"], 16)
    return B.read_parts(s, path)


def writes(s, d):
    li = X.table(s, d, "lineitem")
    cols = ["l_orderkey", "l_linenumber"]
    prev = li.where(F.col("l_returnflag") != "R").select(*cols, F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"))
    new = li.where(F.col("l_returnflag") != "N").select(*cols, (-F.col("l_quantity")).alias("q"), F.col("l_partkey").alias("p"))
    return prev, new, cols


@query("k4_append", """
SELECT event_id, value, NULL::VARCHAR AS queue FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, NULL, event_type FROM events WHERE event_type <> 'click'""")
def _(s, d):
    e = X.table(s, d, "events")
    return B.append(e.where(F.col("event_type") == "click").select("event_id", "value"),
                    e.where(F.col("event_type") != "click").select("event_id", F.col("event_type").alias("queue")))
