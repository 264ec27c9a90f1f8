"""The three studies over the test tables."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.experiments import LONG, METRICS, PARAMS
from catalog.registry import query, rnd
from catalog.series import POP, POP_SQL, trace
from catalog.statistics import CMP_COLS, ks_sql, rho_sql, stats_sql
from catalog.tables import RAW, raw_jobs
from nodehours.plans import studies as P


@query("study_extract", f"""WITH {RAW.strip()}
SELECT 'jobs' AS name, count(*) AS n, sum(nodes)::BIGINT AS total FROM raw UNION ALL SELECT 'node_availability', count(*), sum(busy_nodes + free_nodes)::BIGINT FROM counts_fx""")
def _(s, d):
    out = X.new_path(s, "trace")
    snaps = X.snapshots(s, d).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    paths = P.extract_trace(s, {"jobs": raw_jobs(s, d), "node_availability": snaps}, out)
    j = s.read.parquet(paths["jobs"]).agg(F.lit("jobs").alias("name"), F.count("*").alias("n"), F.sum("nodes").alias("total"))
    a = s.read.parquet(paths["node_availability"]).agg(F.lit("node_availability").alias("name"), F.count("*").alias("n"), F.sum("up_nodes").cast("long").alias("total"))
    return j.unionByName(a)


@query("study_compare_window", f"""WITH {POP_SQL.strip()},
cw AS (SELECT queue, nodes, rt, os - qt AS obs, CASE WHEN has_depend THEN NULL ELSE other_wait_h END AS sim, qt FROM pop WHERE role = 'arrival' AND sub BETWEEN 24 AND 216),
cl AS (SELECT *, coalesce(sim, 240 - qt) AS sim_lb, 'ALL' AS grp FROM cw UNION ALL SELECT *, coalesce(sim, 240 - qt), CASE WHEN queue IN ('error','signup') THEN queue ELSE 'other_queues' END FROM cw),
{stats_sql('grp', 'cl', 'obs', 'sim_lb', ', count(*) AS n_jobs, count(*) FILTER (WHERE sim IS NULL) AS n_sim_censored, sum(nodes * rt) AS node_hours')},
{ks_sql('cl', 'grp', 'obs', 'sim_lb').strip()}, {rho_sql('cl', 'grp', 'obs', 'sim_lb').strip()}
SELECT st.g AS "group", n_jobs, n_sim_censored, round(node_hours, 6) AS node_hours, NULL::DOUBLE AS obs_mean_eligible_h, {CMP_COLS} FROM st JOIN ks USING (g) JOIN rho USING (g)""")
def _(s, d):
    j = trace(s, d).withColumns({"sim": F.when(~F.col("has_depend"), F.col("other_wait_h")), "obs_eligible_h": F.lit(None).cast("double")})
    table, _fit = P.compare_window(j, POP["t0"], POP["t1"], "sim", ["error", "signup"], 24.0, 24.0,
                                   **{k: v for k, v in POP.items() if k not in ("t0", "t1")})
    return rnd(table, 6)


@query("study_compare_window_fit", f"""WITH {POP_SQL.strip()},
cw AS (SELECT queue, os - qt AS obs, CASE WHEN has_depend THEN NULL ELSE other_wait_h END AS sim, qt FROM pop WHERE role = 'arrival' AND sub BETWEEN 24 AND 216),
cl AS (SELECT *, coalesce(sim, 240 - qt) AS sim_lb, 'ALL' AS grp FROM cw UNION ALL SELECT *, coalesce(sim, 240 - qt), CASE WHEN queue IN ('error','signup') THEN queue ELSE 'other_queues' END FROM cw),
{stats_sql('grp', 'cl', 'obs', 'sim_lb', ', count(*) FILTER (WHERE sim IS NULL) AS n_c')}, {ks_sql('cl', 'grp', 'obs', 'sim_lb').strip()},
t AS (SELECT st.*, ks, log2((sim_p50_h + 1/60.0::DOUBLE) / (obs_p50_h + 1/60.0::DOUBLE)) AS l50, log2((sim_mean_h + 1/60.0::DOUBLE) / (obs_mean_h + 1/60.0::DOUBLE)) AS lm FROM st JOIN ks USING (g))
SELECT max(n) FILTER (WHERE g = 'ALL') AS n_compared, max(n_c) FILTER (WHERE g = 'ALL') AS n_sim_censored, round(max(ks) FILTER (WHERE g = 'ALL'), 6) AS ks_all,
 round(max(l50) FILTER (WHERE g = 'ALL'), 6) AS log2_ratio_p50_all, round(avg(ks + abs(lm)) FILTER (WHERE g IN ('error','signup') AND n >= 30), 6) AS fit_score FROM t""")
def _(s, d):
    j = trace(s, d).withColumns({"sim": F.when(~F.col("has_depend"), F.col("other_wait_h")), "obs_eligible_h": F.lit(None).cast("double")})
    _table, fit = P.compare_window(j, POP["t0"], POP["t1"], "sim", ["error", "signup"], 24.0, 24.0,
                                   **{k: v for k, v in POP.items() if k not in ("t0", "t1")})
    return rnd(fit, 6)


@query("study_reduce_scan_whole", f"""WITH {LONG.strip()}, g AS (SELECT 'param_a' AS param, param_a AS lvl, avg(mean) AS m FROM mc WHERE metric = 'm_big' GROUP BY ALL UNION ALL SELECT 'param_b', param_b, avg(mean) FROM mc WHERE metric = 'm_big' GROUP BY ALL),
t AS (SELECT config_hash, mean FROM mc WHERE metric = 'm_big' ORDER BY mean DESC, config_hash LIMIT 3)
SELECT 'stats' AS result, config_hash || '/' || metric AS item, round(mean, 6) AS value FROM mc
UNION ALL SELECT 'main_effect', param || '=' || lvl, round(m, 6) FROM g UNION ALL SELECT 'sensitivity', param, round(max(m) - min(m), 6) FROM g GROUP BY param
UNION ALL SELECT 'top', config_hash, round(mean, 6) FROM t UNION ALL SELECT 'refine', 'tasks', (SELECT count(*) * 5 FROM t)::DOUBLE""")
def _(s, d):
    r = P.reduce_scan(X.results(s, d), "m_big", PARAMS, METRICS, top=3, n_seeds=5)
    row = lambda df, name, item, value: df.select(F.lit(name).alias("result"), item.alias("item"), value.cast("double").alias("value"))
    out = row(r["stats"], "stats", F.concat_ws("/", "config_hash", "metric"), F.col("mean"))
    for p, e in r["main_effects"].items():
        out = out.unionByName(row(e, "main_effect", F.concat(F.lit(f"{p}="), F.col(p)), F.col("mean")))
    out = out.unionByName(row(r["sensitivity"], "sensitivity", F.col("param"), F.col("effect")))
    out = out.unionByName(row(r["top"], "top", F.col("config_hash"), F.col("mean")))
    return rnd(out.unionByName(row(r["refine"].agg(F.count(F.lit(1)).alias("n")), "refine", F.lit("tasks"), F.col("n"))), 6)


@query("study_reduce_scan", f"""WITH {LONG.strip()}, g AS (SELECT 'param_a' AS param, param_a AS lvl, avg(mean) AS m FROM mc WHERE metric = 'm_big' GROUP BY ALL UNION ALL SELECT 'param_b', param_b, avg(mean) FROM mc WHERE metric = 'm_big' GROUP BY ALL)
SELECT param, count(*) AS n_levels, round(max(m) - min(m), 6) AS effect FROM g GROUP BY param""")
def _(s, d):
    r = P.reduce_scan(X.results(s, d), "m_big", PARAMS, METRICS, top=3, n_seeds=5)
    return rnd(r["sensitivity"].select("param", "n_levels", "effect"), 6)
