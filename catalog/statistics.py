"""Aggregations and statistics over waits and deliveries (A1-A14, A27-A32)."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import query, rnd
from nodehours.operators import quantiles as Q
from nodehours.operators import series as T
from nodehours.operators import stats as A

QS = (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
WIN_NH = "nodes * CASE WHEN start_h IS NULL THEN 0 ELSE greatest(0, least(coalesce(end_h, 720), 720) - greatest(0, start_h)) END"


def censored(s, d):
    return T.censor(X.runs(s, d), X.T1, submit="submit_h")


@query("a1_wait_summary", "SELECT queue, count(wait_h) AS n_started, count(*) FILTER (WHERE wait_h IS NULL) AS n_censored, round(avg(wait_h), 6) AS started_mean_h, "
       + ", ".join(f"round(quantile_cont(wait_h, {p}), 6) AS started_{n}_h" for n, p in QS) + ", "
       + ", ".join(f"round(quantile_cont(coalesce(wait_h, 720 - submit_h), {p}), 6) AS lb_{n}_h" for n, p in QS) + " FROM runs_fx GROUP BY queue")
def _(s, d):
    return rnd(A.wait_summary(censored(s, d), ["queue"]), 6)


@query("a1_wait_summary_all", "SELECT count(wait_h) AS n_started, count(*) FILTER (WHERE wait_h IS NULL) AS n_censored, round(avg(wait_h), 6) AS started_mean_h, "
       + ", ".join(f"round(quantile_cont(wait_h, {p}), 6) AS started_{n}_h" for n, p in QS) + ", "
       + ", ".join(f"round(quantile_cont(coalesce(wait_h, 720 - submit_h), {p}), 6) AS lb_{n}_h" for n, p in QS) + " FROM runs_fx")
def _(s, d):
    return rnd(A.wait_summary(censored(s, d)), 6)


@query("a1_line_quantiles_blocks", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999
FROM lineitem GROUP BY l_returnflag""")
def _(s, d):
    from nodehours.blocks import cut_points

    li = X.table(s, d, "lineitem")
    probs = {"p50": 0.5, "p90": 0.9, "p999": 0.999}
    return rnd(Q.quantiles(li, ["l_returnflag"], "l_extendedprice", probs, cuts=cut_points(li, "l_extendedprice")), 6)


@query("a2_queue_percentiles", """
SELECT size_tier, count(*) AS n, max(wait_h) AS wait_max_h, round(quantile_cont(wait_h, 0.5), 6) AS wait_p50_h, round(quantile_cont(wait_h, 0.9), 6) AS wait_p90_h,
 round(quantile_cont(wait_h, 0.95), 6) AS wait_p95_h, round(quantile_cont(wait_h, 0.99), 6) AS wait_p99_h FROM runs_fx WHERE wait_h IS NOT NULL GROUP BY 1""".replace("max(wait_h) AS", "round(max(wait_h), 6) AS"))
def _(s, d):
    return rnd(A.queue_percentiles(X.runs(s, d)), 6)


def ks_sql(src: str, key: str, a: str, b: str) -> str:
    return f"""
u AS (SELECT {key} AS g, {a} AS v, 1 AS na, 0 AS nb FROM {src} WHERE {a} IS NOT NULL UNION ALL SELECT {key}, {b}, 0, 1 FROM {src} WHERE {b} IS NOT NULL),
c AS (SELECT g, v, sum(na) AS na, sum(nb) AS nb FROM u GROUP BY g, v),
f AS (SELECT g, sum(na) OVER w / sum(na) OVER (PARTITION BY g) AS fa, sum(nb) OVER w / sum(nb) OVER (PARTITION BY g) AS fb FROM c WINDOW w AS (PARTITION BY g ORDER BY v)),
ks AS (SELECT g, max(abs(fa - fb)) AS ks FROM f GROUP BY g)"""


def rho_sql(src: str, key: str, a: str, b: str) -> str:
    return f"""
p AS (SELECT {key} AS g, {a} AS x, {b} AS y FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM p),
rho AS (SELECT g, CASE WHEN count(*) > 2 THEN corr(rx, ry) END AS spearman FROM r GROUP BY g)"""


@query("a3_ks", f"WITH {ks_sql('runs_fx', 'queue', 'wait_h', 'other_wait_h').strip()} SELECT g AS queue, round(ks, 8) AS ks FROM ks")
def _(s, d):
    return rnd(Q.ks_distance(X.runs(s, d), "wait_h", "other_wait_h", ["queue"]), 8)


@query("a3_ks_all", f"WITH {ks_sql('runs_fx', '1', 'wait_h', 'other_wait_h').strip()} SELECT round(ks, 8) AS ks FROM ks")
def _(s, d):
    return rnd(Q.ks_distance(X.runs(s, d), "wait_h", "other_wait_h"), 8)


@query("a4_spearman", f"WITH {rho_sql('runs_fx', 'queue', 'k', 'other_wait_h').strip()} SELECT g AS queue, round(spearman, 7) AS spearman FROM rho")
def _(s, d):
    return rnd(Q.spearman(X.runs(s, d), "k", "other_wait_h", ["queue"]), 7)


def stats_sql(key: str, src: str, a: str, b: str, extra: str = "") -> str:
    q = ", ".join(f"quantile_cont({a}, {p}) AS obs_{n}_h, quantile_cont({b}, {p}) AS sim_{n}_h" for n, p in (("p50", .5), ("p90", .9), ("p95", .95)))
    return f"st AS (SELECT {key} AS g, count(*) AS n, avg({a}) AS obs_mean_h, avg({b}) AS sim_mean_h, {q}{extra} FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1)"


CMP_COLS = ("n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("obs_mean_h", "sim_mean_h", "obs_p50_h", "obs_p90_h", "obs_p95_h", "sim_p50_h", "sim_p90_h", "sim_p95_h", "ks", "spearman"))
            + ", round(log2((sim_p50_h + 1/60.0::DOUBLE) / (obs_p50_h + 1/60.0::DOUBLE)), 6) AS log2_ratio_p50, round(log2((sim_mean_h + 1/60.0::DOUBLE) / (obs_mean_h + 1/60.0::DOUBLE)), 6) AS log2_ratio_mean")


@query("a5_compare", f"""WITH {stats_sql('queue', 'runs_fx', 'wait_h', 'other_wait_h')}, pr AS (SELECT * FROM runs_fx WHERE wait_h IS NOT NULL AND other_wait_h IS NOT NULL), {ks_sql('pr', 'queue', 'wait_h', 'other_wait_h').strip()}, {rho_sql('pr', 'queue', 'wait_h', 'other_wait_h').strip()}
SELECT st.g AS queue, {CMP_COLS} FROM st JOIN ks USING (g) JOIN rho USING (g)""")
def _(s, d):
    return rnd(A.compare(X.runs(s, d), "wait_h", "other_wait_h", ["queue"]), 6)


QUEUES = ["click", "error", "view"]
CMP_SRC = """
cw AS (SELECT *, value / 55.0::DOUBLE + 0.3::DOUBLE * (job_id % 5) AS sim0, has_depend AS cens, wait_h / 2 AS elig FROM jobs_fx WHERE submit_h BETWEEN 72 AND 672),
cl AS (SELECT *, CASE WHEN cens THEN 720 - submit_h ELSE sim0 END AS sim_lb, 'ALL' AS grp FROM cw UNION ALL
 SELECT *, CASE WHEN cens THEN 720 - submit_h ELSE sim0 END, CASE WHEN queue IN ('click','error','view') THEN queue ELSE 'other_queues' END FROM cw)"""


def compared(s, d):
    j = X.jobs(s, d).withColumns({"role": F.lit("arrival"), "obs_wait_h": F.col("wait_h"), "sim_censored": F.col("has_depend"),
                                  "obs_eligible_h": F.col("wait_h") / 2})
    sim = F.when(F.col("has_depend"), X.T1 - F.col("submit_h")).otherwise(F.col("value") / 55.0 + 0.3 * (F.col("job_id") % 5))
    return A.comparison_window(j.withColumn("sim_wait_lb_h", sim), 72.0, 672.0)


CMP_SQL = f"""WITH {CMP_SRC.strip()}, {stats_sql('grp', 'cl', 'wait_h', 'sim_lb', ", count(*) AS n_jobs, count(*) FILTER (WHERE cens) AS n_sim_censored, sum(nodes * runtime_h) AS node_hours, avg(elig) AS obs_mean_eligible_h")},
{ks_sql('cl', 'grp', 'wait_h', 'sim_lb').strip()}, {rho_sql('cl', 'grp', 'wait_h', 'sim_lb').strip()}
"""


@query("a6_compare_table", CMP_SQL + f'SELECT st.g AS "group", n_jobs, n_sim_censored, round(node_hours, 6) AS node_hours, round(obs_mean_eligible_h, 6) AS obs_mean_eligible_h, {CMP_COLS} FROM st JOIN ks USING (g) JOIN rho USING (g)')
def _(s, d):
    return rnd(A.compare_table(compared(s, d), QUEUES), 6)


def variants(s, d):
    v = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(f).alias("factor")) for n, f in (("half", 0.5), ("same", 1.0), ("triple", 3.0))])
    df = compared(s, d).select("*", F.explode(v).alias("v")).select("*", "v.variant", "v.factor")
    return df.withColumn("sim_wait_lb_h", F.col("sim_wait_lb_h") * F.col("factor"))


@query("a7_utilization", """
WITH o AS (SELECT queue, nodes, start_h - 3 AS s, start_h - 3 + runtime_h AS e, start_h AS s2, end_h AS e2 FROM jobs_fx)
SELECT queue, round(sum(nodes * greatest(0, least(e, 600) - greatest(s, 72))), 4) AS obs_node_hours, round(sum(nodes * greatest(0, least(e2, 600) - greatest(s2, 72))), 4) AS sim_node_hours,
 round(sum(nodes * greatest(0, least(e, 600) - greatest(s, 72))) / (528 * 9600), 8) AS obs_util_reportable, round(sum(nodes * greatest(0, least(e2, 600) - greatest(s2, 72))) / (528 * 9600), 8) AS sim_util_reportable
FROM o GROUP BY queue""")
def _(s, d):
    t = A.compare_utilization(X.jobs(s, d).withColumn("obs_start_h", F.col("start_h") - 3), 72.0, 600.0, keys=["queue"])
    return t.select("queue", *[F.round(c, k).alias(c) for c, k in (("obs_node_hours", 4), ("sim_node_hours", 4), ("obs_util_reportable", 8), ("sim_util_reportable", 8))])


@query("a7_fit_ranking", f"""WITH {CMP_SRC.strip()},
cv AS (SELECT variant || '/' || grp AS vg, variant, grp, wait_h, sim_lb * factor AS sim_v, cens FROM cl, (VALUES ('half', 0.5::DOUBLE), ('same', 1.0), ('triple', 3.0)) AS v(variant, factor)),
{stats_sql('vg', 'cv', 'wait_h', 'sim_v', ", any_value(variant) AS variant, any_value(grp) AS grp, count(*) FILTER (WHERE cens) AS n_c")}, {ks_sql('cv', 'vg', 'wait_h', 'sim_v').strip()},
t AS (SELECT st.*, ks, log2((sim_p50_h + 1/60.0::DOUBLE) / (obs_p50_h + 1/60.0::DOUBLE)) AS l50, log2((sim_mean_h + 1/60.0::DOUBLE) / (obs_mean_h + 1/60.0::DOUBLE)) AS lm FROM st JOIN ks USING (g)),
s AS (SELECT variant, max(n) FILTER (WHERE grp = 'ALL') AS n_compared, max(n_c) FILTER (WHERE grp = 'ALL') AS n_sim_censored, max(ks) FILTER (WHERE grp = 'ALL') AS ks_all,
 max(l50) FILTER (WHERE grp = 'ALL') AS l50, avg(ks + abs(lm)) FILTER (WHERE grp IN ('click','error','view') AND n >= 30) AS fs FROM t GROUP BY variant)
SELECT variant, n_compared, n_sim_censored, round(ks_all, 6) AS ks_all, round(l50, 6) AS log2_ratio_p50_all, round(fs, 6) AS fit_score, row_number() OVER (ORDER BY fs, variant)::INTEGER AS rank FROM s""")
def _(s, d):
    t = A.compare_table(variants(s, d), QUEUES, keys=["variant"], correlation=False)
    return rnd(A.rank_variants(A.fit_summary(t, QUEUES, ["variant"])), 6)


@query("a8_decision_table", f"""
WITH t AS (SELECT program, count(*) AS n_jobs, count(*) FILTER (WHERE start_h IS NULL) AS unstarted, sum({WIN_NH}) AS nh, sum(nodes * runtime_h) FILTER (WHERE start_h IS NOT NULL) AS cr,
 quantile_cont(wait_h, 0.5) AS p50, quantile_cont(wait_h, 0.95) AS p95, max(wait_h) AS mx FROM runs_fx GROUP BY program)
SELECT program, n_jobs, unstarted, target_share::DOUBLE AS target_share, round(nh / sum(nh) OVER (), 6) AS delivered_share, round(cr / (target_share * 10624 * 8760), 6) AS budget_burn,
 round(p50, 6) AS wait_p50_h, round(p95, 6) AS wait_p95_h, round(mx, 6) AS wait_max_h FROM t JOIN programs_fx USING (program)""")
def _(s, d):
    return rnd(A.decision_table(X.runs(s, d), X.programs(s), X.T1), 6)


BREAK = f"""(SELECT kind, name, count(*) AS submitted, count(start_h) AS started, count(*) FILTER (WHERE start_h IS NULL) AS unstarted, sum({WIN_NH}) AS delivered_nh,
 count(*) FILTER (WHERE end_h <= 720) / 30.0::DOUBLE AS throughput_jpd, max(wait_h) AS wait_max_h, quantile_cont(wait_h, 0.5) AS wait_p50_h, quantile_cont(wait_h, 0.95) AS wait_p95_h
 FROM (SELECT 'q' AS kind, size_tier AS name, * FROM runs_fx UNION ALL SELECT 'prog', program, * FROM runs_fx) GROUP BY kind, name)"""


@query("a9_breakdowns", f"""SELECT kind, name, submitted, started, unstarted, round(delivered_nh, 6) AS delivered_nh, round(throughput_jpd, 6) AS throughput_jpd,
 round(wait_max_h, 6) AS wait_max_h, round(wait_p50_h, 6) AS wait_p50_h, round(wait_p95_h, 6) AS wait_p95_h FROM {BREAK}""")
def _(s, d):
    return rnd(A.breakdowns(X.runs(s, d), X.T1), 6)


NAMES = [("q", "capacity"), ("q", "large"), ("prog", "A"), ("prog", "C")]


@query("a9_breakdowns_wide", "SELECT " + ", ".join(
    f"round(max({m}) FILTER (WHERE kind = '{k}' AND name = '{n}'), 6) AS {k}_{n}_{m}" for k, n in NAMES for m in ("delivered_nh", "wait_p95_h")) + f" FROM {BREAK}")
def _(s, d):
    return rnd(A.breakdowns_wide(A.breakdowns(X.runs(s, d), X.T1), NAMES, ["delivered_nh", "wait_p95_h"]), 6)


@query("a10_project_usage", """
WITH aw AS (SELECT project, sum(nodes * walltime_h) * 0.9 AS award FROM jobs_fx GROUP BY project UNION ALL SELECT 'unused', 1000.0),
d AS (SELECT project, arg_min(program, (submit_h, job_id)) AS program, coalesce(sum(nodes * runtime_h) FILTER (WHERE start_h IS NOT NULL), 0) AS nh FROM runs_fx GROUP BY project)
SELECT project, coalesce(program, '?') AS program, round(coalesce(nh, 0), 5) AS delivered_nh, round(award, 5) AS award_nh, round(100 * coalesce(nh, 0) / award, 5) AS pct_alloc_used FROM aw LEFT JOIN d USING (project)""")
def _(s, d):
    j = X.runs(s, d)
    aw = j.groupBy("project").agg((F.sum(F.col("nodes") * F.col("walltime_h")) * 0.9).alias("award_nh"))
    aw = aw.unionByName(j.agg(F.lit("unused").alias("project"), F.lit(1000.0).alias("award_nh")))
    return rnd(A.project_usage(j, aw), 5)


@query("a11_run_summary", f"""
SELECT count(*) AS n_jobs, count(start_h) AS n_started, count(*) FILTER (WHERE start_h IS NULL) AS n_unstarted, count(*) FILTER (WHERE end_h <= 720) AS n_completed,
 round(sum({WIN_NH}), 5) AS node_hours_delivered, round(count(*) FILTER (WHERE end_h <= 720) / 30.0::DOUBLE, 5) AS throughput_jobs_per_day, round(max(wait_h), 5) AS wait_max_h,
 count(*) FILTER (WHERE nodes >= 1920) AS n_big_jobs, count(*) FILTER (WHERE nodes >= 1920 AND start_h IS NULL) AS n_big_unstarted, round(max(wait_h) FILTER (WHERE nodes >= 1920), 5) AS big_wait_max_h,
 round(quantile_cont(wait_h, 0.5), 5) AS wait_p50_h, round(quantile_cont(wait_h, 0.95), 5) AS wait_p95_h,
 round(quantile_cont(CASE WHEN nodes >= 1920 THEN wait_h END, 0.5), 5) AS big_wait_p50_h, round(quantile_cont(CASE WHEN nodes >= 1920 THEN wait_h END, 0.95), 5) AS big_wait_p95_h,
 round(quantile_cont(CASE WHEN nodes < 1920 THEN wait_h END, 0.5), 5) AS small_wait_p50_h, round(quantile_cont(CASE WHEN nodes < 1920 THEN wait_h END, 0.95), 5) AS small_wait_p95_h,
 (SELECT round(avg(lvl / 96.0::DOUBLE), 5) FROM (SELECT g.t_h, coalesce(sum(j.nodes), 0) AS lvl FROM hours_fx g LEFT JOIN runs_fx j ON j.start_h <= g.t_h AND g.t_h < j.end_h GROUP BY g.t_h)) AS avg_util_pct,
 1920 AS big_thresh_nodes FROM runs_fx""")
def _(s, d):
    return rnd(A.run_summary(X.runs(s, d), X.T1), 5)


@query("a12_program_allocation", """
WITH t AS (SELECT program, sum(nodes * runtime_h) FILTER (WHERE start_h IS NOT NULL) AS nh FROM runs_fx GROUP BY program)
SELECT program, round(nh, 5) AS delivered_nh, round(target_share * 10624 * 8760, 5) AS allocated_nh, target_share::DOUBLE AS target_share, round(nh / (target_share * 10624 * 8760), 7) AS usage_over_allocated,
 round(nh / (target_share * 10624 * 8760 * (720 / 8760.0::DOUBLE)), 7) AS usage_over_prorated, round(nh / (9600 * 8760), 7) AS usage_over_annual_system, round(nh / sum(nh) OVER (), 7) AS delivered_share_of_used
FROM t JOIN programs_fx USING (program)""")
def _(s, d):
    t = A.program_allocation(X.runs(s, d), X.programs(s), X.T1)
    return t.select("program", "target_share", *[F.round(c, 5).alias(c) for c in ("delivered_nh", "allocated_nh")],
                    *[F.round(c, 7).alias(c) for c in t.columns[4:]])


@query("a13_alloc_util", f"SELECT queue, round(sum({WIN_NH}) / sum(CASE WHEN start_h IS NOT NULL THEN nodes * walltime_h END), 7) AS alloc_util FROM runs_fx GROUP BY queue")
def _(s, d):
    return rnd(A.alloc_util(X.runs(s, d), X.T1, ["queue"]), 7)


@query("a14_offered_load", """
WITH o AS (SELECT 'machine' AS scope, sum(nodes * runtime_h) AS o, 10624 * 720.0::DOUBLE AS c, 1.05 AS l FROM runs_fx UNION ALL
 SELECT 'protected_pool', sum(nodes * runtime_h) FILTER (WHERE size_tier = 'capacity'), 40 * 720.0::DOUBLE, 1.02 FROM runs_fx UNION ALL
 SELECT 'outside_partition', sum(nodes * runtime_h) FILTER (WHERE nodes < 1920), (10624 - 4096) * 720.0::DOUBLE, 1.02 FROM runs_fx)
SELECT scope, round(o, 5) AS offered_nh, c AS capacity_nh, round(o / c, 6) AS factor, o / c > l AS oversubscribed FROM o""")
def _(s, d):
    t = A.offered_load(X.runs(s, d), X.T1, "capacity", 40, 1920, 4096)
    return t.select("scope", F.round("offered_nh", 5).alias("offered_nh"), "capacity_nh", F.round("factor", 6).alias("factor"), "oversubscribed")


TIERS = ["capacity", "small", "medium", "large"]


@query("a27_tier_mix", "SELECT program, " + ", ".join(
    f"round(100.0::DOUBLE * count(*) FILTER (WHERE size_tier = '{t}') / count(*), 6) AS {t}_count_pct, round(100 * coalesce(sum(nodes * runtime_h) FILTER (WHERE size_tier = '{t}'), 0) / sum(nodes * runtime_h), 6) AS {t}_nh_pct"
    for t in TIERS) + " FROM runs_fx GROUP BY program")
def _(s, d):
    return rnd(A.tier_mix(X.runs(s, d), TIERS), 6)


@query("a28_ecdf", """
WITH c AS (SELECT program, nodes, count(*) AS n FROM jobs_fx GROUP BY ALL)
SELECT program, nodes, n, round(sum(n) OVER (PARTITION BY program ORDER BY nodes) / sum(n) OVER (PARTITION BY program), 8) AS cdf FROM c""")
def _(s, d):
    return rnd(Q.ecdf(X.jobs(s, d), "nodes", ["program"]), 8)


@query("a29_concentration", """
WITH c AS (SELECT program, "user", sum(nodes * runtime_h) AS nh FROM jobs_fx GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY nh DESC, "user") AS rank FROM c)
SELECT program, "user", rank, round(nh, 5) AS nh, round(sum(nh) OVER (PARTITION BY program ORDER BY rank) / sum(nh) OVER (PARTITION BY program), 7) AS cum_share FROM r""")
def _(s, d):
    j = X.jobs(s, d).withColumn("nh", F.col("nodes") * F.col("runtime_h"))
    t = Q.concentration(j, ["program"], "user", "nh")
    return t.select("program", "user", "rank", F.round("nh", 5).alias("nh"), F.round("cum_share", 7).alias("cum_share"))


@query("a30_uplift", """
WITH dd AS (SELECT range AS d, (SELECT count(*) FROM jobs_fx WHERE floor(submit_h / 24) = range) AS n FROM range(30)),
b AS (SELECT avg(n) AS o FROM dd WHERE NOT (d BETWEEN 2 AND 4) AND NOT (d BETWEEN 20 AND 29))
SELECT w AS "window", round((SELECT avg(n) FROM dd WHERE d BETWEEN lo AND hi), 6) AS inside, round(o, 6) AS outside, round((SELECT avg(n) FROM dd WHERE d BETWEEN lo AND hi) / o, 6) AS uplift
FROM b, (VALUES ('d1', 2, 4), ('d2', 20, 29)) AS v(w, lo, hi)""")
def _(s, d):
    return rnd(A.uplift(X.jobs(s, d), [("d1", 2, 4), ("d2", 20, 33)], 30), 6)


@query("a31_histogram", """
SELECT program, 10.0::DOUBLE * least(floor(least(greatest(value, 0), 200) / 10), 19) AS bin_lo, count(*) AS n FROM jobs_fx GROUP BY ALL""")
def _(s, d):
    return Q.hist(X.jobs(s, d), F.col("value"), 10.0, 0.0, 200.0, ["program"])


@query("a32_describe_by", """
SELECT program, count(*) AS jobs, round(sum(nodes * runtime_h), 5) AS node_hours, round(avg(nodes), 5) AS nodes_mean, max(nodes) AS nodes_max, round(avg(runtime_h), 5) AS runtime_mean,
 round(avg(runtime_h / walltime_h), 5) AS rt_ratio_mean, quantile_cont(nodes::DOUBLE, 0.5) AS nodes_p50, round(quantile_cont(nodes::DOUBLE, 0.9), 5) AS nodes_p90, round(quantile_cont(nodes::DOUBLE, 0.99), 5) AS nodes_p99,
 round(quantile_cont(walltime_h, 0.5), 5) AS walltime_p50, round(quantile_cont(walltime_h, 0.9), 5) AS walltime_p90, round(quantile_cont(runtime_h, 0.5), 5) AS runtime_p50,
 round(sum(nodes * runtime_h) / (SELECT sum(nodes * runtime_h) FROM jobs_fx), 5) AS nh_share, round(count(*) / ((SELECT max(submit_h) - min(submit_h) FROM jobs_fx) / 24), 5) AS arrivals_per_day FROM jobs_fx GROUP BY program""")
def _(s, d):
    j = X.jobs(s, d).withColumn("rt_ratio", F.col("runtime_h") / F.col("walltime_h"))
    span = j.agg(F.max("submit_h") - F.min("submit_h")).scalar()
    return rnd(A.describe_by(j, "program", span), 5)
