"""Recurring findings (F)."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import query, rnd
from nodehours.functions import clean as C
from nodehours.functions import score as S
from nodehours.operators import findings as N


@query("f1_share_over_capacity", "SELECT round(avg(CASE WHEN busy > 8000 THEN 1.0 ELSE 0.0 END), 8) AS share_over, round(max(busy), 4) AS peak FROM conc_fx")
def _(s, d):
    return N.share_over_capacity(X.jobs(s, d), 8000, 0.0, X.T1).select(F.round("share_over", 8).alias("share_over"), F.round("peak", 4).alias("peak"))


@query("f2_waited_despite_free", """
WITH e AS (SELECT start_h AS t, nodes AS d FROM jobs_fx UNION ALL SELECT end_h, -nodes FROM jobs_fx), n AS (SELECT t, sum(d) AS d FROM e GROUP BY t),
lv AS MATERIALIZED (SELECT t, 20000.0 - sum(d) OVER (ORDER BY t) AS free FROM n),
s AS (SELECT j.job_id, coalesce(lv.free, 20000.0) AS free FROM jobs_fx j ASOF LEFT JOIN lv ON j.submit_h >= lv.t),
w AS (SELECT j.job_id, max(lv.free) AS free FROM jobs_fx j JOIN lv ON lv.t > j.submit_h AND lv.t < j.start_h GROUP BY ALL),
b AS (SELECT j.*, start_h > submit_h AS waits, greatest(s.free, coalesce(w.free, s.free)) AS best FROM jobs_fx j JOIN s USING (job_id) LEFT JOIN w USING (job_id) WHERE start_h <= 720)
SELECT queue, count(*) AS n, count(*) FILTER (WHERE start_h - submit_h > 1 AND best >= nodes) AS n_avoidable, round(count(*) FILTER (WHERE start_h - submit_h > 1 AND best >= nodes) / count(*), 8) AS share FROM b GROUP BY queue""")
def _(s, d):
    return rnd(N.waited_despite_free(X.jobs(s, d), 20000.0, X.T1), 8)


@query("f2_most_free", """
WITH e AS (SELECT start_h AS t, nodes AS d FROM jobs_fx UNION ALL SELECT end_h, -nodes FROM jobs_fx), n AS (SELECT t, sum(d) AS d FROM e GROUP BY t),
lv AS MATERIALIZED (SELECT t, 20000.0 - sum(d) OVER (ORDER BY t) AS free FROM n),
s AS (SELECT j.job_id, coalesce(lv.free, 20000.0) AS free FROM jobs_fx j ASOF LEFT JOIN lv ON j.submit_h >= lv.t),
w AS (SELECT j.job_id, max(lv.free) AS free FROM jobs_fx j JOIN lv ON lv.t > j.submit_h AND lv.t < j.start_h GROUP BY ALL)
SELECT job_id, CASE WHEN start_h > submit_h THEN greatest(s.free, coalesce(w.free, s.free)) END::DOUBLE AS most_free FROM jobs_fx JOIN s USING (job_id) LEFT JOIN w USING (job_id)""")
def _(s, d):
    return N.free_while_waiting(X.jobs(s, d), 20000.0).select("job_id", "most_free")


@query("f3_peak_concurrency", """
WITH r AS (SELECT 'project' AS scope, queue, project AS entity, 1 AS size, start_h, end_h FROM jobs_fx UNION ALL SELECT 'queue', queue, '*', nodes, start_h, end_h FROM jobs_fx),
e AS (SELECT scope, queue, entity, start_h AS t, size AS d FROM r WHERE end_h > start_h UNION ALL SELECT scope, queue, entity, end_h, -size FROM r WHERE end_h > start_h),
n AS (SELECT scope, queue, entity, t, sum(d) AS d FROM e GROUP BY ALL), l AS (SELECT *, sum(d) OVER (PARTITION BY scope, queue, entity ORDER BY t) AS lvl FROM n)
SELECT scope, queue, entity, max(lvl)::BIGINT AS peak FROM l GROUP BY ALL""")
def _(s, d):
    return N.peak_concurrency(X.jobs(s, d), X.queues(s))


@query("f4_eligible_wait", """
WITH j AS (SELECT *, CASE WHEN job_id % 4 <> 0 AND k > 50 THEN submit_h + (k - 50) / 600.0::DOUBLE ELSE submit_h END AS el FROM jobs_fx)
SELECT queue, count(*) AS n, round(avg(has_depend::INT), 8) AS depend_share, round(quantile_cont(start_h - submit_h, 0.5), 6) AS wait_p50_h, round(quantile_cont(start_h - el, 0.5), 6) AS eligible_wait_p50_h FROM j GROUP BY queue""")
def _(s, d):
    et = F.when(F.col("job_id") % 4 != 0, F.col("submit_h") + (F.col("k") - 50) / 600.0)
    t = N.eligible_wait(X.jobs(s, d).withColumn("eligible_at_h", C.arrival(et, "submit_h")))
    return t.select("queue", "n", F.round("depend_share", 8).alias("depend_share"), F.round("wait_p50_h", 6).alias("wait_p50_h"), F.round("eligible_wait_p50_h", 6).alias("eligible_wait_p50_h"))


GROWTH = ("100000.0::DOUBLE * ((e*3600)**2 / least(greatest(walltime_h*3600, 21600.0), 43200.0)**3 * project_priority * nodes / 10624)"
          " + enable_backfill * least(50.0, e*3600/84600.0::DOUBLE)")


@query("f5_score_regression", f"""
WITH g AS (SELECT ln({GROWTH}) AS y, ln(e) AS x1, ln(nodes) AS x2, ln(walltime_h) AS x3, ln(project_priority) AS x4
  FROM (SELECT *, 744.0::DOUBLE - submit_h AS e FROM jobs_fx) WHERE enable_wfp = 1 AND e > 0 AND nodes > 0 AND walltime_h > 0 AND project_priority > 0),
m AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(x4) AS m4, count(*) AS n FROM g),
c AS (SELECT y - my AS y, x1 - m1 AS x1, x2 - m2 AS x2, x3 - m3 AS x3, x4 - m4 AS x4 FROM g, m),
p1 AS (SELECT regr_slope(x2, x1) AS r12, regr_slope(x3, x1) AS r13, regr_slope(x4, x1) AS r14 FROM c),
c1 AS (SELECT y, x1, x2 - r12 * x1 AS x2, x3 - r13 * x1 AS x3, x4 - r14 * x1 AS x4 FROM c, p1),
p2 AS (SELECT regr_slope(x3, x2) AS r23, regr_slope(x4, x2) AS r24 FROM c1),
c2 AS (SELECT y, x1, x2, x3 - r23 * x2 AS x3, x4 - r24 * x2 AS x4 FROM c1, p2),
p3 AS (SELECT regr_slope(x4, x3) AS r34 FROM c2),
c3 AS (SELECT y, x1, x2, x3, x4 - r34 * x3 AS x4 FROM c2, p3),
k AS (SELECT regr_slope(y, x1) AS k1, regr_slope(y, x2) AS k2, regr_slope(y, x3) AS k3, regr_slope(y, x4) AS k4, var_pop(y) AS v,
  var_pop(x1) AS v1, var_pop(x2) AS v2, var_pop(x3) AS v3, var_pop(x4) AS v4 FROM c3),
b AS (SELECT *, k3 - r34 * k4 AS b3, k2 - r23 * (k3 - r34 * k4) - r24 * k4 AS b2, k1*k1*v1 + k2*k2*v2 + k3*k3*v3 + k4*k4*v4 AS fit FROM k, p1, p2, p3, m),
t AS (SELECT *, k1 - r12 * b2 - r13 * b3 - r14 * k4 AS b1 FROM b)
SELECT u.term, round(u.coefficient, 6) AS coefficient, round(fit / v, 6) AS r2, round(sqrt(v - fit), 6) AS rmse, n FROM t,
 LATERAL (VALUES ('intercept', my - b1 * m1 - b2 * m2 - b3 * m3 - k4 * m4), ('eligible_h', b1), ('nodes', b2), ('walltime_h', b3), ('project_priority', k4)) AS u(term, coefficient)""")
def _(s, d):
    j = X.jobs(s, d).where(F.col("enable_wfp") == 1).withColumn("eligible_h", S.eligible(744.0))
    j = j.withColumn("growth", S.score_exact(F.col("eligible_h")) - F.col("base_score") - F.col("score_boost"))
    return rnd(N.score_regression(j, "growth", ["eligible_h", "nodes", "walltime_h", "project_priority"]), 6)


@query("f5_single_factor", """
WITH g AS (SELECT ln(GROWTH) AS y, ln(744.0::DOUBLE - submit_h) AS x FROM (SELECT *, 744.0::DOUBLE - submit_h AS e FROM jobs_fx) WHERE enable_wfp = 1),
m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n FROM g)
SELECT 'intercept' AS term, round(a, 6) AS coefficient, round(r2, 6) AS r2, n FROM m UNION ALL SELECT 'eligible_h', round(b, 6), round(r2, 6), n FROM m""".replace("GROWTH", GROWTH))
def _(s, d):
    j = X.jobs(s, d).where(F.col("enable_wfp") == 1).withColumn("eligible_h", S.eligible(744.0))
    j = j.withColumn("growth", S.score_exact(F.col("eligible_h")) - F.col("base_score") - F.col("score_boost"))
    return rnd(N.score_regression(j, "growth", ["eligible_h"]).drop("rmse"), 6)
