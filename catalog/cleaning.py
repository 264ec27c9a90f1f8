"""Projections, cleaning and scalar functions (C)."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import query, rnd
from nodehours.functions import clean as C


@query("c1_hms_hours", "SELECT job_id, round(split_part(walltime_hms,':',1)::DOUBLE + split_part(walltime_hms,':',2)::DOUBLE/60"
       " + split_part(walltime_hms,':',3)::DOUBLE/3600, 6) AS hours FROM jobs_fx")
def _(s, d):
    return rnd(X.jobs(s, d).select("job_id", C.hms_hours("walltime_hms").alias("hours")), 6)


@query("c2_hms_two_part", """
WITH t AS (SELECT job_id, CASE WHEN job_id % 3 = 0 THEN substr(walltime_hms, 5) WHEN job_id % 3 = 1 THEN walltime_hms ELSE 'x' || walltime_hms END AS w FROM jobs_fx)
SELECT job_id, round(CASE WHEN job_id % 3 = 0 THEN split_part(w,':',1)::DOUBLE/60 + split_part(w,':',2)::DOUBLE/3600
 WHEN job_id % 3 = 1 THEN split_part(w,':',1)::DOUBLE + split_part(w,':',2)::DOUBLE/60 + split_part(w,':',3)::DOUBLE/3600 END, 6) AS hours FROM t""")
def _(s, d):
    w = F.when(F.col("job_id") % 3 == 0, F.substring("walltime_hms", 5, 99)).when(
        F.col("job_id") % 3 == 1, F.col("walltime_hms")).otherwise(F.concat(F.lit("x"), "walltime_hms"))
    return rnd(X.jobs(s, d).select("job_id", C.hms_hours(w, two_part=True).alias("hours")), 6)


@query("c3_json_fields", """
SELECT event_id, json_extract_string(props,'$.k') AS k, json_extract_string(props,'$.depend') IS NOT NULL AS has_depend FROM events""")
def _(s, d):
    return C.json_fields(X.table(s, d, "events"), "props", plain=["k"], present={"has_depend": "depend"}).select(
        "event_id", "k", "has_depend")


@query("c3_json_nested", """
SELECT job_id, nodes::VARCHAR AS nodect, project AS award, CASE WHEN has_depend THEN 'afterok:' || job_id END AS depend, has_depend FROM jobs_fx""")
def _(s, d):
    j = X.jobs(s, d)
    raw = j.select("job_id", F.to_json(F.struct(
        F.when(F.col("has_depend"), F.concat(F.lit("afterok:"), F.col("job_id").cast("string"))).alias("depend"),
        F.struct(F.col("nodes").alias("nodect"), F.col("project").alias("award")).alias("Resource_List"))).alias("raw"))
    return C.json_fields(raw, "raw", plain=["depend"], nested={"Resource_List": ["nodect", "award"]},
                         present={"has_depend": "depend"}).drop("raw")


@query("c4_ts_lenient", """
SELECT job_id, date_trunc('second', ts) AS weekday_ts, CASE WHEN job_id % 5 <> 0 THEN date_trunc('second', ts) END AS iso_ts FROM jobs_fx""")
def _(s, d):
    iso = F.when(F.col("job_id") % 5 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return X.jobs(s, d).select("job_id", C.ts_weekday("etime_txt").alias("weekday_ts"), C.ts_lenient(iso).alias("iso_ts"))


@query("c5_num_lenient", """
SELECT job_id, TRY_CAST(CASE WHEN job_id % 4 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) AS x FROM jobs_fx""")
def _(s, d):
    x = F.when(F.col("job_id") % 4 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return C.num_lenient(X.jobs(s, d).select("job_id", x.alias("x")), ["x"])


@query("c6_wait_hours", "SELECT job_id, round(coalesce(queue_time / 3600.0::DOUBLE, start_h - submit_h), 6) AS wait_h FROM jobs_fx")
def _(s, d):
    return rnd(X.jobs(s, d).select("job_id", C.wait_hours_rel("queue_time", "start_h", "submit_h").alias("wait_h")), 6)


@query("c7_state_counts", """
SELECT *, (busy_nodes + free_nodes)::INTEGER AS up_nodes, (n - busy_nodes - free_nodes - resv_nodes)::INTEGER AS down_nodes FROM counts_fx""")
def _(s, d):
    return C.state_counts(X.snapshots(s, d))


@query("c8_map_program", """
SELECT coalesce(CASE queue WHEN 'click' THEN 'interactive' WHEN 'view' THEN 'interactive' WHEN 'error' THEN 'debug' END, 'other') AS program,
 count(*) AS n, sum(CASE WHEN queue IN ('click','view','error') THEN 1 ELSE 0 END)::BIGINT AS n_mapped FROM jobs_fx GROUP BY 1""")
def _(s, d):
    m = {"click": "interactive", "view": "interactive", "error": "debug"}
    return X.jobs(s, d).groupBy(C.map_values("queue", m).alias("program")).agg(
        F.count("*").alias("n"), F.count(C.map_values("queue", m, None)).alias("n_mapped"))


@query("c9_repair_walltime", """
WITH t AS (SELECT job_id, runtime_h, CASE WHEN job_id % 5 = 0 THEN NULL WHEN job_id % 5 = 1 THEN runtime_h * 0.5 ELSE walltime_h END AS w FROM jobs_fx),
u AS (SELECT job_id, runtime_h, CASE WHEN w IS NULL OR w < runtime_h THEN greatest(runtime_h * 1.5, 0.1) ELSE w END AS w FROM t)
SELECT job_id, round(w, 6) AS walltime_h, round(least(greatest(runtime_h / w, 0.001), 1.0), 6) AS rt_ratio FROM u""")
def _(s, d):
    w = F.when(F.col("job_id") % 5 == 1, F.col("runtime_h") * 0.5).when(F.col("job_id") % 5 != 0, F.col("walltime_h"))
    fixed = C.repaired_walltime(w, "runtime_h")
    return rnd(X.jobs(s, d).select("job_id", fixed.alias("walltime_h"), C.runtime_ratio("runtime_h", fixed).alias("rt_ratio")), 6)


@query("c10_size_tier", f"SELECT job_id, {X.TIER_CASE} AS size_tier FROM (SELECT job_id, nodes * 3 AS nodes FROM jobs_fx)")
def _(s, d):
    return X.jobs(s, d).select("job_id", C.size_tier(F.col("nodes") * 3, X.tiers()).alias("size_tier"))


@query("c11_alloc_offset", """
SELECT o_orderkey, ((month(o_orderdate) - 7 + 12) % 12)::INTEGER AS alloc_off,
 (((7 - 1 + floor(floor(o_totalprice / 24) / 30)::BIGINT) % 12) + 1)::INTEGER AS sim_month FROM orders""")
def _(s, d):
    return X.table(s, d, "orders").select("o_orderkey", C.alloc_offset(F.month("o_orderdate"), 7).alias("alloc_off"),
                                          C.cal_month_at("o_totalprice", 7).alias("sim_month"))


@query("c12_rel_hours", "SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10')) / 3.6e9::DOUBLE, 6) AS rel_h FROM events")
def _(s, d):
    return rnd(X.table(s, d, "events").select("event_id", C.hours_since("ts", "2024-01-10").alias("rel_h")), 6)


@query("c13_arrival", """
WITH t AS (SELECT job_id, submit_h, CASE WHEN job_id % 4 <> 0 THEN submit_h + (k - 50) / 600.0::DOUBLE END AS et FROM jobs_fx),
u AS (SELECT *, CASE WHEN et IS NOT NULL AND et > submit_h THEN et ELSE submit_h END AS arrive_h FROM t)
SELECT job_id, round(arrive_h, 6) AS arrive_h, arrive_h > submit_h + 1/60.0::DOUBLE AS moved FROM u""")
def _(s, d):
    et = F.when(F.col("job_id") % 4 != 0, F.col("submit_h") + (F.col("k") - 50) / 600.0)
    a = C.arrival(et, "submit_h")
    return rnd(X.jobs(s, d).select("job_id", a.alias("arrive_h"), C.moved_arrival(a, "submit_h").alias("moved")), 6)


@query("c14_clip_runtime", """
SELECT job_id, round(least(greatest(value / 40.0::DOUBLE - 0.5, 0), walltime_h + 0.25), 6) AS runtime_h FROM jobs_fx WHERE walltime_h > 0""")
def _(s, d):
    return rnd(X.jobs(s, d).where(F.col("walltime_h") > 0).select(
        "job_id", C.clip_runtime(F.col("value") / 40.0 - 0.5, "walltime_h", 0.25).alias("runtime_h")), 6)


@query("c15_bounded_slowdown", """
SELECT job_id, round(greatest(1.0, (wait_h + runtime_h) / greatest(runtime_h, 10.0::DOUBLE/60.0::DOUBLE)), 4) AS slowdown FROM jobs_fx""")
def _(s, d):
    return rnd(X.jobs(s, d).select("job_id", C.bounded_slowdown("wait_h", "runtime_h").alias("slowdown")))


@query("c16_window_runtime", """
SELECT job_id, round(CASE WHEN start_h IS NULL THEN 0 ELSE greatest(0, least(coalesce(end_h, 500), 500) - greatest(0, start_h)) END, 6) AS run_h FROM runs_fx""")
def _(s, d):
    return rnd(X.runs(s, d).select("job_id", C.window_runtime("start_h", "end_h", 500.0).alias("run_h")), 6)


@query("c17_fill_scoring", """
SELECT job_id, coalesce(TRY_CAST(CASE WHEN job_id % 3 = 0 THEN 'none' ELSE project_priority::VARCHAR END AS DOUBLE), 25.0::DOUBLE) AS project_priority,
 51.0::DOUBLE AS base_score, 0.0::DOUBLE AS queue_priority, 50.0::DOUBLE AS backfill_max FROM jobs_fx""")
def _(s, d):
    raw = X.jobs(s, d).select("job_id", F.when(F.col("job_id") % 3 == 0, F.lit("none")).otherwise(
        F.col("project_priority").cast("string")).alias("project_priority"), F.lit(None).cast("string").alias("base_score"))
    return C.fill_scoring(raw).select("job_id", "project_priority", "base_score", "queue_priority", "backfill_max")


@query("c18_queue_dim", """
WITH q AS (SELECT event_type AS name, CASE WHEN event_type = 'view' THEN 'Route' ELSE 'Execution' END AS queue_type,
  CASE WHEN min(event_id) % 2 = 0 THEN NULL ELSE 16 END AS min_nodes, max(user_id)::DOUBLE AS max_run_per_user FROM events GROUP BY event_type
 UNION ALL SELECT 'R' || user_id, 'Execution', 1, 1.0::DOUBLE FROM events GROUP BY user_id)
SELECT name, coalesce(min_nodes, 1)::INTEGER AS min_nodes, max_run_per_user FROM q WHERE queue_type = 'Execution' AND NOT regexp_matches(name, '^[RMS][0-9]+$')""")
def _(s, d):
    e = X.table(s, d, "events")
    q = e.groupBy(F.col("event_type").alias("name")).agg(
        F.when(F.col("event_type") == "view", "Route").otherwise("Execution").alias("queue_type"),
        F.when(F.min("event_id") % 2 != 0, 16).alias("min_nodes"), F.max("user_id").cast("double").alias("max_run_per_user"))
    r = e.groupBy("user_id").agg(F.lit(1)).select(F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("name"),
                                                 F.lit("Execution").alias("queue_type"), F.lit(1).alias("min_nodes"),
                                                 F.lit(1.0).alias("max_run_per_user"))
    return C.queue_dim(q.unionByName(r)).select("name", "min_nodes", "max_run_per_user")


@query("c19_parse_limit", "SELECT job_id, k::DOUBLE AS per_user, (2 * k)::DOUBLE AS per_project, NULL::DOUBLE AS overall FROM jobs_fx")
def _(s, d):
    return X.jobs(s, d).select("job_id", C.parse_limit("limit_txt", "u").alias("per_user"),
                               C.parse_limit("limit_txt", "p").alias("per_project"), C.parse_limit("limit_txt", "o").alias("overall"))


@query("c20_exclude", """
SELECT queue, project, count(*) AS n FROM jobs_fx WHERE NOT regexp_matches(project, '^(p1[0-9])') AND queue NOT IN ('view','click') GROUP BY ALL""")
def _(s, d):
    j = C.exclude(C.exclude(X.jobs(s, d), "project", r"p1\d"), "queue", values=["view", "click"])
    return j.groupBy("queue", "project").agg(F.count("*").alias("n"))


@query("c21_check_jobs", """
WITH li AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.01 THEN NULL ELSE l_returnflag END AS queue,
  (l_quantity - 2)::INTEGER AS nodes, l_tax AS walltime_h, l_discount - 0.02 AS runtime_h FROM lineitem)
SELECT 'duplicate_key' AS rule, coalesce(sum(c - 1), 0)::BIGINT AS n FROM (SELECT count(*) AS c FROM li GROUP BY l_orderkey, l_linenumber)
UNION ALL SELECT 'null_queue', count(*) FILTER (WHERE queue IS NULL) FROM li
UNION ALL SELECT 'nonpositive_nodes', count(*) FILTER (WHERE nodes <= 0) FROM li
UNION ALL SELECT 'nonpositive_walltime_h', count(*) FILTER (WHERE walltime_h <= 0) FROM li
UNION ALL SELECT 'negative_runtime_h', count(*) FILTER (WHERE runtime_h < 0) FROM li
UNION ALL SELECT 'missing_columns', 1""")
def _(s, d):
    li = X.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_discount") >= 0.01, F.col("l_returnflag")).alias("queue"),
        (F.col("l_quantity") - 2).cast("int").alias("nodes"), F.col("l_tax").alias("walltime_h"),
        (F.col("l_discount") - 0.02).alias("runtime_h"))
    return C.check_jobs(li, ["queue", "nodes", "walltime_h", "runtime_h", "submit_h"], ["l_orderkey", "l_linenumber"], ["queue"])


@query("c21_band_gaps", """
WITH b AS (SELECT DISTINCT (p_size - p_size % 7) AS lo, (p_size - p_size % 7) + 5 + (p_size // 7) % 3 AS hi FROM part),
w AS (SELECT lo, hi, lag(hi) OVER (ORDER BY lo, hi) AS prev_hi FROM b)
SELECT lo, hi, prev_hi, CASE WHEN lo > coalesce(prev_hi + 1, 0) THEN 'gap' ELSE 'overlap' END AS kind FROM w WHERE lo <> coalesce(prev_hi + 1, 0)""")
def _(s, d):
    lo = F.col("p_size") - F.col("p_size") % 7
    p = X.table(s, d, "part").select(lo.alias("lo"), (lo + 5 + F.floor(F.col("p_size") / 7).cast("int") % 3).alias("hi"))
    return C.band_gaps(p, "lo", "hi", first=0)


@query("c23_dense_codes", """
SELECT job_id, (dense_rank() OVER (ORDER BY project) - 1)::INTEGER AS project_code, (dense_rank() OVER (ORDER BY queue) - 1)::INTEGER AS queue_code FROM jobs_fx""")
def _(s, d):
    return C.dense_codes(X.jobs(s, d).select("job_id", "project", "queue"), ["project", "queue"]).drop("project", "queue")


@query("c24_config_hash", """
SELECT job_id, substr(sha256('{"k":' || k || ',"project":"' || project || '","queue":"' || queue || '"}'), 1, 12) AS config_hash FROM jobs_fx""")
def _(s, d):
    return X.jobs(s, d).select("job_id", C.config_hash(["queue", "k", "project"]).alias("config_hash"))


@query("c25_label_round_trip", """
SELECT job_id, '[[1,' || k || '],[512,' || (k + 1) || ']]' AS label, k::BIGINT AS small_cap, 2 AS n_points FROM jobs_fx""")
def _(s, d):
    lab = C.label_json(F.array(F.array(F.lit(1).cast("long"), F.col("k").cast("long")), F.array(F.lit(512).cast("long"), (F.col("k") + 1).cast("long"))))
    back = C.label_parse("label", "array<array<bigint>>")
    return X.jobs(s, d).select("job_id", lab.alias("label")).select(
        "job_id", "label", back[0][1].alias("small_cap"), F.size(back).alias("n_points"))


@query("c26_math_surface", """
SELECT job_id, floor((k - 50) / 7.0::DOUBLE)::BIGINT AS fdiv, ((k - 50) - floor((k - 50) / 7.0::DOUBLE) * 7)::DOUBLE AS fmod, round(pow(k, 1.5), 4) AS pw,
 least(k, 40) AS mn, greatest(k, 40) AS mx, abs(k - 50) AS ab, round(exp(-k / 25.0::DOUBLE), 6) AS ex,
 round(CASE WHEN k > 0 THEN ln(k) END, 6) AS lg, round(ln(1 + value), 6) AS l1p, round(sqrt(value), 6) AS sq,
 ceil(value)::BIGINT AS ce, floor(value)::BIGINT AS fl, least(greatest(k, 20), 60) AS cl,
 CASE WHEN (k > 50 AND nodes > 2000) OR NOT (k > 10) THEN 1 ELSE 0 END AS pick, (k & 12) | (nodes & 3) AS bits FROM jobs_fx""")
def _(s, d):
    k, n = F.col("k"), F.col("nodes")
    return rnd(X.jobs(s, d).select(
        "job_id", C.math_floor_div(k - 50, F.lit(7.0)).alias("fdiv"), C.math_mod((k - 50).cast("double"), F.lit(7.0)).alias("fmod"),
        F.round(F.pow(k, F.lit(1.5)), 4).alias("pw"), C.math_min(k, F.lit(40)).alias("mn"), C.math_max(k, F.lit(40)).alias("mx"),
        F.abs(k - 50).alias("ab"), F.exp(-k / 25.0).alias("ex"), C.math_log(k).alias("lg"), F.log1p("value").alias("l1p"),
        F.sqrt("value").alias("sq"), F.ceil("value").alias("ce"), F.floor("value").alias("fl"), C.math_clip(k, 20, 60).alias("cl"),
        F.when(((k > 50) & (n > 2000)) | ~(k > 10), 1).otherwise(0).alias("pick"),
        k.bitwiseAND(12).bitwiseOR(n.bitwiseAND(3)).alias("bits")), 6)
