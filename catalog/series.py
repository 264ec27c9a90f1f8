"""Populations, interval algebra and time series (T)."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.lookups import profile
from catalog.registry import query, rnd
from nodehours import blocks as B
from nodehours.functions.constants import PRODUCTION_NODES
from nodehours.operators import series as T

POP = dict(t0=240.0, t1=480.0, exclude_regex=r"cl|zz", exclude_queues=["view"], max_run_count=1, grace=0.1)


def trace(s, d):
    et = F.when(F.col("job_id") % 4 != 0, F.col("submit_h") + (F.col("k") - 50) / 600.0)
    end = F.when(F.col("job_id") % 29 != 0, F.col("end_h"))
    return (X.jobs(s, d).withColumns({"eligible_at_h": et, "end_h": end, "walltime_h": F.col("walltime_h") - 0.12})
            .withColumnRenamed("submit_h", "qtime_h"))


POP_SQL = """
base AS (SELECT *, submit_h AS q, CASE WHEN job_id % 4 <> 0 THEN submit_h + (k - 50) / 600.0::DOUBLE END AS et, CASE WHEN job_id % 29 <> 0 THEN end_h END AS e2, walltime_h - 0.12 AS w2 FROM jobs_fx),
ov AS (SELECT *, regexp_matches(queue, '^(cl|zz)') AS is_res, queue IN ('view') AS is_l, run_count > 1 AS is_req FROM base WHERE e2 IS NOT NULL AND q < 480 AND e2 > 240),
kept AS (SELECT *, (CASE WHEN et IS NOT NULL AND et > q THEN et ELSE q END) - 240 AS sub, q - 240 AS qt, start_h - 240 AS os, e2 - 240 AS oe,
  least(greatest(runtime_h, 0), w2 + 0.1) AS rt FROM ov WHERE NOT is_res AND NOT is_l AND NOT is_req),
pop AS (SELECT *, CASE WHEN os < 0 AND oe > 0 THEN 'running_at_t0' WHEN sub < 0 AND os >= 0 THEN 'queued_at_t0' WHEN sub >= 0 THEN 'arrival' END AS role FROM kept WHERE w2 > 0)"""


@query("t1_population", f"""WITH {POP_SQL.strip()}
SELECT job_id, role, round(sub, 6) AS submit_h, round(qt, 6) AS qtime_h, round(CASE WHEN role = 'running_at_t0' THEN os END, 6) AS initial_start_h,
 round(os - qt, 6) AS obs_wait_h, round(rt, 6) AS runtime_h, 0.0::DOUBLE AS queue_priority FROM pop WHERE role IS NOT NULL""")
def _(s, d):
    p = T.population(trace(s, d), **POP)
    return rnd(p.select("job_id", "role", "submit_h", "qtime_h", "initial_start_h", "obs_wait_h", "runtime_h", "queue_priority"), 6)


@query("t2_population_notes", f"""WITH {POP_SQL.strip()}
SELECT (SELECT count(*) FROM base) AS n_trace_rows, count(*) AS n_window_overlap, count(*) FILTER (WHERE is_res) AS dropped_reservation_jobs,
 round(coalesce(sum(nodes * runtime_h) FILTER (WHERE is_res), 0) / sum(nodes * runtime_h), 6) AS dropped_reservation_nh_frac,
 count(*) FILTER (WHERE is_req AND NOT is_res) AS dropped_requeued_jobs,
 round(coalesce(sum(nodes * runtime_h) FILTER (WHERE is_req AND NOT is_res), 0) / sum(nodes * runtime_h), 6) AS dropped_requeued_nh_frac,
 (SELECT count(*) FROM pop WHERE role = 'running_at_t0') AS n_running_at_t0, (SELECT count(*) FROM pop WHERE role = 'queued_at_t0') AS n_queued_at_t0,
 (SELECT count(*) FROM pop WHERE sub >= 0) AS n_arrivals, (SELECT count(*) FROM pop WHERE role IS NOT NULL AND sub > qt + 1/60.0::DOUBLE) AS n_moved,
 (SELECT count(*) FROM kept WHERE has_depend) AS n_with_depend FROM ov""")
def _(s, d):
    return rnd(T.population_notes(trace(s, d), **POP), 6)


def timeline_sql(src: str, bins: str, dt: str, t1: str, keys: str = "", digits: int = 4) -> str:
    k = f"{keys}, " if keys else ""
    gk = f"(SELECT DISTINCT {keys} FROM {src}) kk," if keys else ""
    on = " AND ".join(f"j.{c.strip()} = g.{c.strip()}" for c in keys.split(",")) + " AND " if keys else ""
    return f"""WITH g AS (SELECT {k}b.t_h, least(b.t_h + {dt}, {t1}) AS e FROM {gk} {bins} b WHERE b.t_h < {t1})
SELECT {"".join(f"g.{c.strip()}, " for c in keys.split(",")) if keys else ""}g.t_h, round(coalesce(sum(j.nodes * (least(j.end_h, g.e) - greatest(j.start_h, g.t_h))), 0) / (g.e - g.t_h), {digits}) AS busy_nodes,
 round(coalesce(sum(j.nodes * (least(j.end_h, g.e) - greatest(j.start_h, g.t_h))), 0), {digits}) AS node_hours
FROM g LEFT JOIN {src} j ON {on}j.start_h < g.e AND j.end_h > g.t_h GROUP BY ALL, g.e""".replace("GROUP BY ALL, g.e", "GROUP BY " + ("".join(f"g.{c.strip()}, " for c in keys.split(",")) if keys else "") + "g.t_h, g.e")


@query("t3_busy_timeline", timeline_sql("jobs_fx", "(SELECT range * 24.0::DOUBLE AS t_h FROM range(31))", "24", "734.5"))
def _(s, d):
    return rnd(T.busy_timeline(X.jobs(s, d), 0.0, 734.5, 24.0))


@query("t3_busy_timeline_hourly", timeline_sql("jobs_fx", "hours_fx", "1", "720", "queue"))
def _(s, d):
    return rnd(T.busy_timeline(X.jobs(s, d), 0.0, 720.0, 1.0, keys=["queue"]))


@query("t3_busy_timeline_big", timeline_sql("big_fx", "(SELECT range * 24.0::DOUBLE AS t_h FROM range(2560))", "24", "61440", "l_returnflag"))
def _(s, d):
    return rnd(T.busy_timeline(X.big_intervals(s, d), 0.0, 61440.0, 24.0, keys=["l_returnflag"]))


@query("t4_utilization", """
SELECT queue, round(sum(greatest(0, nodes * (least(end_h, 700) - greatest(start_h, 72)))), 4) AS node_hours,
 round(sum(greatest(0, nodes * (least(end_h, 700) - greatest(start_h, 72)))) / (628 * 9600), 8) AS utilization FROM jobs_fx GROUP BY queue""")
def _(s, d):
    u = T.utilization(X.jobs(s, d), 72.0, 700.0, PRODUCTION_NODES, keys=["queue"])
    return u.select("queue", F.round("node_hours", 4).alias("node_hours"), F.round("utilization", 8).alias("utilization"))


@query("t5_availability", "SELECT round(t_h, 7) AS t_h, up, reserved, available FROM avail_fx")
def _(s, d):
    a = T.availability(X.usable(s, d), X.completed(s, d), 10624)
    return a.select(F.round("t_h", 7).alias("t_h"), "up", "reserved", "available")


@query("t5_availability_big", """
WITH w AS (SELECT l_extendedprice / 100 AS a, l_extendedprice / 100 + l_quantity AS b, l_quantity AS n FROM lineitem),
e AS (SELECT a AS t, n AS d FROM w UNION ALL SELECT b, -n FROM w UNION ALL SELECT t_h, 0 FROM usable_fx),
l AS (SELECT t, sum(d) OVER (ORDER BY t) AS reserved FROM (SELECT t, sum(d) AS d FROM e GROUP BY t)),
u AS (SELECT t_h, max(up) * 100 AS up FROM usable_fx GROUP BY t_h),
p AS (SELECT l.t, reserved, coalesce(u.up, (SELECT arg_min(up, t_h) FROM u)) AS up FROM l ASOF LEFT JOIN u ON l.t >= u.t_h)
SELECT round(t, 6) AS t_h, up, round(reserved, 4)::DOUBLE AS reserved, round(greatest(0.0, least(least(up, 900000.0), 900000.0 - reserved)), 4)::DOUBLE AS available FROM p""")
def _(s, d):
    start = F.col("l_extendedprice") / 100
    w = X.table(s, d, "lineitem").select(start.alias("start_h"), (start + F.col("l_quantity")).alias("end_h"), F.col("l_quantity").alias("nodes"))
    a = T.availability(X.usable(s, d).withColumn("up", F.col("up") * 100), w, 900000)
    return a.select(F.round("t_h", 6).alias("t_h"), "up", F.round("reserved", 4).alias("reserved"), F.round("available", 4).alias("available"))


@query("t5_mean_available", """
SELECT round(avg(coalesce(a.available, (SELECT arg_min(available, t_h) FROM avail_fx))), 5) AS mean_available FROM quarters_fx q ASOF LEFT JOIN avail_fx a ON q.t_h >= a.t_h""")
def _(s, d):
    return rnd(T.mean_available(B.stored(T.availability(X.usable(s, d), X.completed(s, d), 10624)), 0.0, X.T1), 5)


@query("t6_concurrency", "SELECT bin, t_h, round(busy, 4) AS busy, reserved, round(busy + reserved, 4) AS concurrent FROM conc_fx")
def _(s, d):
    return rnd(T.concurrency(X.jobs(s, d), X.completed(s, d), X.T1))


@query("t6_capacity", """
SELECT round(quantile_cont(busy + reserved, 0.9), 4) AS q_conc, round(max(busy + reserved), 4) AS max_conc, round(avg(busy), 4) AS mean_busy,
 least(10624, round_even(quantile_cont(busy + reserved, 0.9), 0)::BIGINT + 64)::BIGINT AS capacity FROM conc_fx""")
def _(s, d):
    return rnd(T.capacity_estimate(T.concurrency(X.jobs(s, d), X.completed(s, d), X.T1), 0.9, 64))


@query("t7_usable_series", """
WITH g AS (SELECT range AS bin, range * 0.25::DOUBLE AS t_h FROM range(2881)),
b AS (SELECT g.bin, g.t_h, u.t_h AS bt, u.up AS bv FROM g ASOF LEFT JOIN usable_fx u ON g.t_h >= u.t_h),
f AS (SELECT g.bin, u.t_h AS ft, u.up AS fv FROM g ASOF LEFT JOIN usable_fx u ON g.t_h < u.t_h),
m AS (SELECT b.bin, t_h, CASE WHEN ft IS NOT NULL AND (bt IS NULL OR ft - t_h < t_h - bt) THEN ft - t_h ELSE t_h - bt END AS gap,
 CASE WHEN ft IS NOT NULL AND (bt IS NULL OR ft - t_h < t_h - bt) THEN fv ELSE bv END AS v FROM b JOIN f USING (bin)),
s AS (SELECT bin, t_h, CASE WHEN gap <= 0.4 THEN v ELSE (SELECT quantile_cont(up, 0.75) FROM usable_fx WHERE t_h BETWEEN 0 AND 720) END AS up FROM m)
SELECT s.bin, s.t_h, round(greatest(up, ceil(round(coalesce(c.busy + c.reserved, (SELECT busy + reserved FROM conc_fx WHERE bin = 2879)), 6))), 4) AS usable FROM s LEFT JOIN conc_fx c USING (bin)""")
def _(s, d):
    return rnd(T.usable_series(X.usable(s, d), X.jobs(s, d), X.completed(s, d), X.T1, 0.4))


@query("t8_free_profile", """
SELECT 'general' AS pool, round(t_h, 6) AS t_h, free, min(free) OVER (ORDER BY t_h) AS ahead FROM profile_fx""")
def _(s, d):
    p = profile(s, d)
    return p.select("pool", F.round("t_h", 6).alias("t_h"), "free", "ahead")


@query("t8_free_profile_pools", """
WITH avail AS (SELECT t_h, available FROM avail_fx), r AS (SELECT *, CASE WHEN queue = 'error' THEN 'debug' ELSE 'general' END AS pool FROM running_fx),
p AS (SELECT pool, x.t_h FROM (SELECT req_end AS t_h FROM running_fx WHERE req_end < 420 UNION SELECT t_h FROM avail_fx WHERE t_h > 360 AND t_h < 420 UNION SELECT 360.0::DOUBLE UNION SELECT 420.0::DOUBLE) x, (VALUES ('debug'), ('general')) AS v(pool)),
f AS (SELECT p.pool, p.t_h, floor(CASE WHEN p.pool = 'debug' THEN least(a.available, 2000) ELSE greatest(a.available - 2000, 0) END
  - coalesce((SELECT sum(nodes) FROM r WHERE r.pool = p.pool AND r.req_end > p.t_h), 0) + 1e-9::DOUBLE) AS free FROM p ASOF LEFT JOIN avail a ON p.t_h >= a.t_h)
SELECT pool, round(t_h, 6) AS t_h, free, min(free) OVER (PARTITION BY pool ORDER BY t_h) AS ahead FROM f""")
def _(s, d):
    avail = T.availability(X.usable(s, d), X.completed(s, d), 10624)
    j = X.jobs(s, d).withColumn("pool", F.when(F.col("queue") == "error", "debug").otherwise("rest"))
    return T.free_profile(j, avail, 360.0, 420.0, {"debug": 2000.0}).select("pool", F.round("t_h", 6).alias("t_h"), "free", "ahead")


@query("t9_release_time", """
WITH r AS (SELECT start_h + walltime_h AS e, sum(nodes) AS n FROM running_fx GROUP BY 1), c AS (SELECT e, sum(n) OVER (ORDER BY e) + 200 AS upto FROM r)
SELECT job_id, round(CASE WHEN nodes <= 200 THEN 360 ELSE coalesce((SELECT min(e) FROM c WHERE c.upto >= j.nodes), 360 + walltime_h) END, 6) AS release_h FROM jobs_fx j""")
def _(s, d):
    j = X.jobs(s, d)
    run = j.where((F.col("start_h") <= 360) & (F.col("end_h") > 360))
    return rnd(T.release_time(j.select("job_id", "nodes", "walltime_h"), run, 200.0, 360.0).select("job_id", "release_h"), 6)


LEVEL = "(SELECT g.t_h, coalesce(sum(j.nodes), 0) AS lvl FROM hours_fx g LEFT JOIN runs_fx j ON j.start_h <= g.t_h AND g.t_h < j.end_h GROUP BY g.t_h)"


@query("t10_daily_utilization", f"SELECT floor(t_h / 24)::INTEGER AS day, round(avg(lvl / 9600.0::DOUBLE), 6) AS util_frac FROM {LEVEL} GROUP BY 1")
def _(s, d):
    return rnd(T.daily_utilization(X.runs(s, d), X.T1), 6)


DEPTH = """(SELECT t.size_tier, g.t_h, count(j.job_id) AS depth FROM hours_fx g CROSS JOIN (SELECT DISTINCT size_tier FROM runs_fx) t
 LEFT JOIN runs_fx j ON j.size_tier = t.size_tier AND j.submit_h <= g.t_h AND (j.start_h IS NULL OR g.t_h < j.start_h) GROUP BY 1, 2)"""


@query("t11_queue_depth", f"SELECT t_h, size_tier, depth FROM {DEPTH}")
def _(s, d):
    return T.queue_depth(X.runs(s, d), X.T1, 1.0)


CUM = """(SELECT {k}, g.t_h, coalesce((SELECT sum(nodes * runtime_h) FROM runs_fx j WHERE j.{k} = p.{k} AND j.start_h <= g.t_h), 0) AS nh
 FROM {g} g, (SELECT DISTINCT {k} FROM runs_fx) p)"""


@query("t12_delivered_program", f"SELECT program, t_h, round(nh, 4) AS delivered_nh FROM {CUM.format(k='program', g='hours_fx')}")
def _(s, d):
    return rnd(T.delivered_over_time(X.runs(s, d), X.T1, 1.0))


@query("t12_delivered_project", f"SELECT project, t_h, round(nh, 4) AS delivered_nh FROM {CUM.format(k='project', g='(SELECT range * 24.0::DOUBLE AS t_h FROM range(31))')}")
def _(s, d):
    return rnd(T.delivered_over_time(X.runs(s, d), X.T1, 24.0, by=["project"]))


@query("t13_telemetry", f"""WITH lv AS {LEVEL}, dp AS {DEPTH}
SELECT t_h, 'busy_nodes' AS metric, '_all' AS program, lvl::DOUBLE AS value FROM lv UNION ALL SELECT t_h, 'utilization', '_all', round(lvl / 9600.0::DOUBLE, 7) FROM lv
UNION ALL SELECT t_h, 'queue_depth_tier', size_tier, depth::DOUBLE FROM dp UNION ALL SELECT t_h, 'queue_depth', '_all', sum(depth)::DOUBLE FROM dp GROUP BY t_h
UNION ALL SELECT t_h, 'delivered_nh', program, round(nh, 4) FROM {CUM.format(k='program', g='hours_fx')}""")
def _(s, d):
    t = T.telemetry(X.runs(s, d), X.T1, 1.0)
    return t.withColumn("value", F.when(F.col("metric") == "utilization", F.round("value", 7)).otherwise(F.round("value", 4)))


@query("t14_grid", """
WITH b AS (SELECT floor(submit_h / 6)::BIGINT AS bin, count(*) AS n, sum(value) AS v FROM jobs_fx GROUP BY 1)
SELECT range AS bin, range * 6.0::DOUBLE AS t_h, 6.0::DOUBLE AS width_h, coalesce(n, 0)::BIGINT AS n, round(coalesce(v, 0), 4) AS v
FROM range((SELECT ceil(max(submit_h) / 6)::BIGINT FROM jobs_fx)) r LEFT JOIN b ON b.bin = r.range""")
def _(s, d):
    j = X.jobs(s, d)
    top = j.agg(F.ceil(F.max("submit_h") / 6)).first()[0] * 6.0
    sums = j.groupBy(F.floor(F.col("submit_h") / 6).alias("bin")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return rnd(B.fill_grid(sums, [], ["n", "v"], 0.0, top, 6.0))


@query("t15_censor", """
SELECT job_id, round(wait_h, 6) AS wait_h, round(coalesce(wait_h, 720 - submit_h), 6) AS wait_lb_h, start_h IS NULL AS censored FROM runs_fx""")
def _(s, d):
    return rnd(T.censor(X.runs(s, d), X.T1, submit="submit_h").select("job_id", "wait_h", "wait_lb_h", "censored"), 6)
