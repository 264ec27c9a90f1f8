"""Experiment grids and Monte Carlo reduction (A22-A26, A33, K1, K2, X)."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import query, rnd
from catalog.workload import uni
from nodehours.functions import score as S
from nodehours.operators import experiments as E

METRICS = ["m_avg", "m_p95", "m_n", "m_big"]
PARAMS = ["param_a", "param_b"]
LONG = """
lg AS (SELECT config_hash, seed, param_a, param_b, m AS metric, v FROM results_fx, LATERAL (VALUES ('m_avg', m_avg), ('m_p95', m_p95), ('m_n', m_n), ('m_big', m_big)) AS t(m, v) WHERE status = 'OK'),
ns AS (SELECT config_hash, count(*) AS n_seeds FROM results_fx WHERE status = 'OK' GROUP BY 1),
mc AS (SELECT config_hash, n_seeds, param_a, param_b, metric, count(v) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, 1.96 * coalesce(stddev_samp(v), 0) / sqrt(count(v)) AS ci95,
 CASE WHEN avg(v) <> 0 THEN coalesce(stddev_samp(v), 0) / avg(v) END AS cv, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95
 FROM lg JOIN ns USING (config_hash) GROUP BY ALL)"""


def stats(s, d):
    return E.mc_summary(X.results(s, d), PARAMS, METRICS)


@query("a22_mc_summary", f"WITH {LONG.strip()} SELECT config_hash, n_seeds, param_a, param_b, metric, n, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in E.MC_STATS) + " FROM mc")
def _(s, d):
    return rnd(stats(s, d), 6)


NAMED = {"m_avg": "avg_discount", "m_p95": "q_quantity_p95", "m_n": "n_lines", "m_big": "big_lines"}


@query("a22_mc_summary_by_name", f"WITH {LONG.strip()} SELECT config_hash, n_seeds, param_a, param_b, CASE metric "
       + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NAMED.items()) + " END AS metric, n, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in E.MC_STATS) + " FROM mc")
def _(s, d):
    # parameters and metrics are told apart by their names alone
    return rnd(E.mc_summary(X.results(s, d).withColumnsRenamed(NAMED)), 6)


@query("a22_mc_wide", f"WITH {LONG.strip()} SELECT config_hash, n_seeds, param_a, param_b, "
       + ", ".join(f"round(max({c}) FILTER (WHERE metric = '{m}'), 5) AS {m}__{c}" for m in ("m_avg", "m_n") for c in E.MC_STATS) + " FROM mc GROUP BY ALL")
def _(s, d):
    return E.mc_wide(stats(s, d), PARAMS, ["m_avg", "m_n"], 5)


@query("a23_seed_agg", """
WITH p AS (SELECT l_linenumber AS seed, CASE l_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS program, avg(l_tax) AS share, max(l_extendedprice) AS wait_max FROM lineitem GROUP BY ALL)
SELECT program, count(*) AS n_seeds, round(avg(share), 8) AS share_mean, round(stddev_samp(share), 8) AS share_sd, round(avg(wait_max), 6) AS wait_max_mean, round(stddev_samp(wait_max), 6) AS wait_max_sd FROM p GROUP BY program""")
def _(s, d):
    li = X.table(s, d, "lineitem")
    prog = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    per = li.groupBy(F.col("l_linenumber").alias("seed"), prog.alias("program")).agg(F.avg("l_tax").alias("share"), F.max("l_extendedprice").alias("wait_max"))
    t = E.seed_agg(per, ["program"], ["share", "wait_max"])
    return t.select("program", "n_seeds", *[F.round(c, 8).alias(c) for c in ("share_mean", "share_sd")], *[F.round(c, 6).alias(c) for c in ("wait_max_mean", "wait_max_sd")])


@query("a24_main_effect", f"WITH {LONG.strip()} SELECT param_a, count(*) AS n_configs, round(avg(mean), 6) AS mean, round(avg(ci95), 6) AS ci95 FROM mc WHERE metric = 'm_p95' GROUP BY param_a")
def _(s, d):
    return rnd(E.main_effect(stats(s, d), "param_a", "m_p95"), 6)


@query("a25_sensitivity", f"""WITH {LONG.strip()}, g AS (SELECT metric, 'param_a' AS param, param_a AS lvl, avg(mean) AS m FROM mc GROUP BY ALL UNION ALL SELECT metric, 'param_b', param_b, avg(mean) FROM mc GROUP BY ALL),
e AS (SELECT metric, param, count(*) AS n_levels, max(m) - min(m) AS effect FROM g GROUP BY ALL HAVING count(*) >= 2)
SELECT metric, param, n_levels, round(effect, 6) AS effect, (row_number() OVER (PARTITION BY metric ORDER BY effect DESC, param))::INTEGER AS rank FROM e""")
def _(s, d):
    return rnd(E.sensitivity(stats(s, d), PARAMS), 6)


def per_queue(s, d):
    li = X.table(s, d, "lineitem")
    cols = [F.avg(F.when(F.col("l_suppkey") % 3 == i, F.col("l_quantity"))).alias(f"q_{n}_wait_p95_h") for i, n in enumerate(("small", "medium", "large"))]
    return li.groupBy(F.col("l_returnflag").alias("param_a"), F.col("l_linenumber").alias("seed")).agg(*cols, F.lit("OK").alias("status"))


@query("a26_cross_series", """
WITH w AS (SELECT l_returnflag AS param_a, l_linenumber, l_suppkey % 3 AS g, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT param_a, CASE g WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS name, round(avg(v), 6) AS mean FROM w GROUP BY ALL""")
def _(s, d):
    return rnd(E.cross_series(per_queue(s, d), "param_a", "q_", "_wait_p95_h"), 6)


@query("a33_rollup", """
SELECT CASE param_a WHEN 'A' THEN 24 WHEN 'N' THEN 48 ELSE 48 END::BIGINT AS small_cap, round(avg(m_p95), 6) AS m_p95, round(avg(m_avg), 10) AS m_avg FROM results_fx WHERE status = 'OK' GROUP BY 1""")
def _(s, d):
    label = F.when(F.col("param_a") == "A", "[[1,24],[512,48]]").otherwise("[[1,48],[512,48]]")
    cap = F.get_json_object(label, "$[0][1]").cast("long")
    t = E.rollup_by(X.results(s, d), cap, "small_cap", ["m_p95", "m_avg"])
    return t.select("small_cap", F.round("m_p95", 6).alias("m_p95"), F.round("m_avg", 10).alias("m_avg"))


@query("k1_top_configs", f"WITH {LONG.strip()} SELECT config_hash, round(mean, 6) AS mean FROM mc WHERE metric = 'm_avg' ORDER BY mean DESC, config_hash LIMIT 3")
def _(s, d):
    return rnd(E.top_configs(stats(s, d), "m_avg", 3).select("config_hash", "mean"), 6)


@query("k1_worst_configs", f"WITH {LONG.strip()} SELECT config_hash, round(mean, 6) AS mean FROM mc WHERE metric = 'm_avg' ORDER BY mean, config_hash LIMIT 2")
def _(s, d):
    return rnd(E.top_configs(stats(s, d), "m_avg", 2, ascending=True).select("config_hash", "mean"), 6)


@query("k2_refine", """
WITH t AS (SELECT config_hash, avg(m_p95) AS objective, any_value(param_a) AS param_a, any_value(param_b) AS param_b FROM results_fx WHERE status = 'OK' GROUP BY 1 ORDER BY objective, config_hash LIMIT 3)
SELECT config_hash, round(objective, 6) AS objective, param_a, param_b, seed FROM t, (SELECT (100 + range)::INTEGER AS seed FROM range(5))""")
def _(s, d):
    return rnd(E.refine(X.results(s, d), "m_p95", 3, 5, PARAMS, maximize=False, base_seed=100), 6)


@query("x1_full_factorial", """
SELECT a AS l_returnflag, b AS l_linestatus, c AS l_linenumber, (SELECT count(*) FROM lineitem WHERE l_returnflag = a AND l_linestatus = b AND l_linenumber = c) AS n
FROM (SELECT DISTINCT l_returnflag AS a FROM lineitem), (SELECT DISTINCT l_linestatus AS b FROM lineitem), (SELECT DISTINCT l_linenumber AS c FROM lineitem)""")
def _(s, d):
    li = X.table(s, d, "lineitem")
    cols = ["l_returnflag", "l_linestatus", "l_linenumber"]
    grid = E.full_factorial(s, E.levels(li, cols))
    return grid.join(li.groupBy(*cols).agg(F.count("*").alias("n")), cols, "left").fillna(0, ["n"])


def lhs_sql(n: int, seed: int) -> str:
    def dim(name, lo, hi):
        u = uni(f"'{name}'", "i::VARCHAR", f"'perm{seed}'")
        j = uni(f"'{name}'", "i::VARCHAR", f"'jitter{seed}'")
        return f"{lo}::DOUBLE + ((row_number() OVER (ORDER BY {u}, i) - 1 + {j}) / {n}) * ({hi}::DOUBLE - {lo}::DOUBLE) AS {name}"

    return (f"SELECT i, {dim('age', 0.5, 4.0)}, {dim('weight', -0.002, 0.002)}, CASE floor({uni(chr(39) + 'form' + chr(39), 'i::VARCHAR', chr(39) + 'choice' + str(seed) + chr(39))} * 2) "
            f"WHEN 0 THEN 'linear' ELSE 'log' END AS form FROM range({n}) t(i)")


@query("x2_lhs_what_if", f"""WITH p AS ({lhs_sql(12, 4)})
SELECT i, round(age, 7) AS age, round(weight, 9) AS weight, form, count(*) AS n,
 round(avg(age * greatest(0, 360 - submit_h) + weight * nodes + CASE WHEN form = 'log' THEN ln(nodes) ELSE 0 END), 6) AS mean,
 round(max(age * greatest(0, 360 - submit_h) + weight * nodes + CASE WHEN form = 'log' THEN ln(nodes) ELSE 0 END), 6) AS "max" FROM p, jobs_fx GROUP BY i, age, weight, form""")
def _(s, d):
    pts = E.latin_hypercube(s, {"age": (0.5, 4.0), "weight": (-0.002, 0.002)}, {"form": ["linear", "log"]}, 12, 4)
    f = F.col("age") * S.eligible(360.0) + F.col("weight") * F.col("nodes") + F.when(F.col("form") == "log", F.ln("nodes")).otherwise(0.0)
    t = E.what_if(X.jobs(s, d), pts, f)
    return t.select("i", F.round("age", 7).alias("age"), F.round("weight", 9).alias("weight"), "form", "n", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"))


@query("x2_what_if_grid", """
SELECT age, weight, queue, count(*) AS n, round(avg(age * greatest(0, 360 - submit_h) + weight * nodes), 4) AS mean,
 round(max(age * greatest(0, 360 - submit_h) + weight * nodes), 4) AS "max"
FROM jobs_fx, (SELECT DISTINCT l_quantity::DOUBLE AS age, l_discount::DOUBLE AS weight FROM lineitem WHERE l_linenumber = 1) GROUP BY ALL""")
def _(s, d):
    pts = X.table(s, d, "lineitem").where("l_linenumber = 1").select(F.col("l_quantity").cast("double").alias("age"), F.col("l_discount").cast("double").alias("weight"))
    f = F.col("age") * S.eligible(360.0) + F.col("weight") * F.col("nodes")
    return rnd(E.what_if(X.jobs(s, d), pts, f, ["queue"], at_once=300), 4)


@query("x3_tasks", """
SELECT substr(sha256('{"l_linestatus":"' || b || '","l_returnflag":"' || a || '"}'), 1, 12) AS config_hash, a AS l_returnflag, b AS l_linestatus, (40 + range)::INTEGER AS seed
FROM (SELECT DISTINCT l_returnflag AS a, l_linestatus AS b FROM lineitem), range(7)""")
def _(s, d):
    return E.tasks(X.table(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct(), 7, 40)
