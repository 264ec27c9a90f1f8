"""Joins and lookups (J)."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import query, rnd
from nodehours.operators import lookups as L
from nodehours.operators import sampling as R
from nodehours.operators import series as T
from nodehours.sources import tables


@query("j1_with_queue", """
SELECT job_id, coalesce(q.max_walltime_h, 24.0) AS max_walltime_h, q.max_run_per_user, coalesce(q.max_nodes_total, 10624)::INTEGER AS max_nodes_total
FROM jobs_fx j LEFT JOIN (SELECT * FROM queues_fx WHERE name <> 'purchase') q ON q.name = j.queue""")
def _(s, d):
    q = X.queues(s).where(F.col("name") != "purchase")
    out = L.with_queue(X.jobs(s, d), q, {"max_walltime_h": 24.0, "max_run_per_user": None, "max_nodes_total": 10624})
    return out.select("job_id", "max_walltime_h", "max_run_per_user", "max_nodes_total")


@query("j2_route", """
SELECT job_id, name AS routed FROM (SELECT job_id, name, row_number() OVER (PARTITION BY job_id ORDER BY max_nodes - min_nodes, name) AS rn
 FROM jobs_fx j LEFT JOIN queues_fx q ON q.routable AND j.nodes BETWEEN q.min_nodes AND q.max_nodes AND j.walltime_h <= q.max_walltime_h + 1e-9) WHERE rn = 1""")
def _(s, d):
    return L.route(X.jobs(s, d), X.queues(s)).select("job_id", "routed")


@query("j3_asof_step", """
SELECT job_id, coalesce(u.up, (SELECT arg_min(up, t_h) FROM usable_fx)) AS up FROM jobs_fx j ASOF LEFT JOIN usable_fx u ON j.submit_h >= u.t_h""")
def _(s, d):
    return L.asof_step(X.jobs(s, d).select("job_id", "submit_h"), X.usable(s, d), "submit_h", "up").select("job_id", "up")


@query("j3_asof_step_dimension", """
SELECT l_orderkey, l_linenumber, coalesce(u.up, (SELECT arg_min(up, t_h) FROM usable_fx)) AS up
FROM (SELECT *, l_extendedprice / 100 AS at FROM lineitem) l ASOF LEFT JOIN usable_fx u ON l.at >= u.t_h""")
def _(s, d):
    facts = X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100).alias("at"))
    return L.asof_step(facts, X.usable(s, d), "at", "up", dimension=True).select("l_orderkey", "l_linenumber", "up")


@query("j3_asof_step_big", """
WITH se AS (SELECT l_extendedprice AS t_h, max(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(se.q, (SELECT arg_min(q, t_h) FROM se)) AS q FROM (SELECT o_orderkey, o_totalprice / 4 AS at FROM orders) o ASOF LEFT JOIN se ON o.at >= se.t_h""")
def _(s, d):
    series = X.table(s, d, "lineitem").groupBy(F.col("l_extendedprice").alias("t_h")).agg(F.max("l_quantity").alias("q"))
    orders = X.table(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 4).alias("at"))
    return L.asof_step(orders, series, "at", "q").select("o_orderkey", "q")


NEIGHBOURS = """
WITH b AS (SELECT g.bin, g.t_h, u.t_h AS bt, u.up AS bv FROM hours_fx g ASOF LEFT JOIN usable_fx u ON g.t_h >= u.t_h),
f AS (SELECT g.bin, u.t_h AS ft, u.up AS fv FROM hours_fx g ASOF LEFT JOIN usable_fx u ON g.t_h < u.t_h),
n AS (SELECT b.*, ft, fv FROM b JOIN f USING (bin))"""


@query("j4_nearest_within", NEIGHBOURS + """,
m AS (SELECT bin, t_h, CASE WHEN ft IS NOT NULL AND (bt IS NULL OR ft - t_h < t_h - bt) THEN ft - t_h ELSE t_h - bt END AS gap,
 CASE WHEN ft IS NOT NULL AND (bt IS NULL OR ft - t_h < t_h - bt) THEN fv ELSE bv END AS v FROM n)
SELECT bin, t_h, round(gap, 6) AS gap_h, round(CASE WHEN gap <= 0.2 THEN v ELSE (SELECT quantile_cont(up, 0.75) FROM usable_fx WHERE t_h BETWEEN 0 AND 720) END, 4) AS up FROM m""")
def _(s, d):
    n = L.nearest_within(X.usable(s, d), 0.0, X.T1, 1.0, 0.2, value="up")
    return n.select("bin", "t_h", F.round("gap_h", 6).alias("gap_h"), F.round("up", 4).alias("up"))


@query("j5_interpolate", NEIGHBOURS + """
SELECT bin, t_h, round(CASE WHEN bt IS NULL THEN fv WHEN ft IS NULL THEN bv ELSE bv + (fv - bv) * (t_h - bt) / (ft - bt) END, 5) AS up FROM n""")
def _(s, d):
    return rnd(L.interpolate(X.usable(s, d), 0.0, X.T1, 1.0, value="up"), 5)


@query("j5_interpolate_off_grid", NEIGHBOURS.replace("hours_fx", "(SELECT range AS bin, range * 0.7::DOUBLE AS t_h FROM range(859))") + """
SELECT bin, round(t_h, 6) AS t_h, round(CASE WHEN bt IS NULL THEN fv WHEN ft IS NULL THEN bv ELSE bv + (fv - bv) * (t_h - bt) / (ft - bt) END, 5) AS up FROM n""")
def _(s, d):
    t = L.interpolate(X.usable(s, d), 0.0, 600.2, 0.7, value="up")  # the last point lies past the end
    return t.select("bin", F.round("t_h", 6).alias("t_h"), F.round("up", 5).alias("up"))


@query("j6_covering_sum", """
SELECT job_id, coalesce((SELECT sum(nodes) FROM resvok_fx r WHERE r.start_h <= j.submit_h AND j.submit_h < r.end_h), 0)::DOUBLE AS covered FROM jobs_fx j""")
def _(s, d):
    return L.covering_sum(X.jobs(s, d).select("job_id", "submit_h"), X.completed(s, d), "submit_h").select("job_id", "covered")


@query("j6_covering_sum_big", """
WITH e AS (SELECT l_extendedprice AS t, l_quantity AS w FROM lineitem UNION ALL SELECT l_extendedprice + 100 * l_quantity, -l_quantity FROM lineitem),
n AS (SELECT t, sum(w) AS d FROM e GROUP BY t), l AS (SELECT t, sum(d) OVER (ORDER BY t) AS lvl FROM n)
SELECT o_orderkey, round(coalesce(lvl, 0), 4) AS covered FROM (SELECT o_orderkey, o_totalprice / 4 AS at FROM orders) o ASOF LEFT JOIN l ON o.at >= l.t""")
def _(s, d):
    li = X.table(s, d, "lineitem").select(F.col("l_extendedprice").alias("start_h"), (F.col("l_extendedprice") + 100 * F.col("l_quantity")).alias("end_h"), "l_quantity")
    orders = X.table(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 4).alias("at"))
    return rnd(L.covering_sum(orders, li, "at", weight="l_quantity").select("o_orderkey", "covered"), 4)


@query("j7_walltime_cap", """
SELECT job_id, coalesce((SELECT arg_max(cap, min_nodes) FROM breakpoints_fx b WHERE b.min_nodes <= j.nodes - 100), 2.0) AS cap FROM jobs_fx j""")
def _(s, d):
    return X.jobs(s, d).select("job_id", L.walltime_cap(F.col("nodes") - 100, X.BREAKPOINTS, 2.0).alias("cap"))


@query("j8_smallest_nodes", """
WITH b AS (SELECT job_id, nodes, (SELECT min(min_nodes) FROM breakpoints_fx b WHERE b.cap >= j.walltime_h AND b.min_nodes <= 1950) AS lo FROM jobs_fx j)
SELECT job_id, CASE WHEN lo IS NOT NULL AND greatest(lo, nodes) <= 1950 THEN greatest(lo, nodes) END::INTEGER AS new_nodes FROM b""")
def _(s, d):
    return X.jobs(s, d).select("job_id", L.smallest_nodes_for("nodes", "walltime_h", X.BREAKPOINTS, 1950).alias("new_nodes"))


AFFECTED = """
aff AS (SELECT "window", project FROM (SELECT w.name AS "window", project,
  row_number() OVER (PARTITION BY w.name ORDER BY ('0x' || substr(md5(w.name || '|' || project || '|11'), 1, 13))::BIGINT, project) AS rn,
  count(*) OVER (PARTITION BY w.name) AS n FROM deadlines_fx w, (SELECT DISTINCT project FROM jobs_fx) p)
 WHERE rn <= greatest(1, round_even(0.4 * n, 0)))"""


@query("j9_deadline_mult", f"""WITH {AFFECTED.strip()},
m AS (SELECT j.job_id, product(w.mult) AS p FROM jobs_fx j JOIN deadlines_fx w ON j.submit_h BETWEEN w.s AND w.e
 JOIN aff a ON a."window" = w.name AND a.project = j.project GROUP BY j.job_id)
SELECT job_id, round(coalesce(p, 1.0), 6) AS mult FROM jobs_fx LEFT JOIN m USING (job_id)""")
def _(s, d):
    j = X.jobs(s, d)
    aff = R.affected_projects(j.select("project").distinct(), [w[0] for w in X.DEADLINES], 0.4, 11)
    return rnd(L.deadline_mult(j, X.DEADLINES, aff).select("job_id", "mult"), 6)


@query("j10_overlapping", "SELECT reservation_id, nodes FROM resv_fx WHERE state IN ('COMPLETED') AND start_h < 500 AND end_h > 200 AND nodes > 0")
def _(s, d):
    return L.overlapping(X.reservations(s, d), 200.0, 500.0, states=["COMPLETED"]).select("reservation_id", "nodes")


@query("j11_earliest_fit", """
WITH last AS (SELECT max(t_h) AS tl FROM profile_fx),
req AS (SELECT DISTINCT nodes, walltime_h FROM jobs_fx),
cand AS (SELECT r.nodes, r.walltime_h, p.t_h, (SELECT min(t_h) FROM profile_fx x WHERE x.t_h > p.t_h AND x.free < r.nodes) AS brk
 FROM req r JOIN profile_fx p ON p.free >= r.nodes JOIN last ON p.t_h < tl),
fit AS (SELECT nodes, walltime_h, min(t_h) AS t FROM cand WHERE brk IS NULL OR brk >= t_h + walltime_h - 1e-9 GROUP BY ALL)
SELECT job_id, round(t, 6) AS fit_h FROM jobs_fx LEFT JOIN fit USING (nodes, walltime_h)""")
def _(s, d):
    prof = profile(s, d).where(F.col("pool") == "general")
    return rnd(L.earliest_fit(X.jobs(s, d).select("job_id", "nodes", "walltime_h"), prof).select("job_id", "fit_h"), 6)


def profile(s, d):
    avail = T.availability(X.usable(s, d), X.completed(s, d), 10624)
    return T.free_profile(X.jobs(s, d), avail, 360.0, 420.0)


def audit_sql(start: str, limits: dict[str, str]) -> str:
    parts = []
    for scope, cap in limits.items():
        ent = "'*'" if scope == "queue" else f'"{scope}"::VARCHAR'
        size = "nodes" if scope == "queue" else "1"
        parts.append(f"SELECT '{scope}' AS scope, queue, {ent} AS entity, {size} AS size, {start} AS a, end_h AS b, q.{cap} AS cap "
                     "FROM jobs_fx JOIN queues_fx q ON q.name = queue")
    return f"""WITH r AS ({' UNION ALL '.join(parts)}),
e AS (SELECT scope, queue, entity, cap, a AS t, size AS d, 1 AS st FROM r WHERE b > a UNION ALL SELECT scope, queue, entity, cap, b, -size, 0 FROM r WHERE b > a),
n AS (SELECT scope, queue, entity, cap, t, sum(d) AS d, sum(st) AS st FROM e GROUP BY ALL),
l AS (SELECT *, sum(d) OVER (PARTITION BY scope, queue, entity ORDER BY t) AS lvl FROM n)
SELECT scope, queue, entity, max(lvl)::BIGINT AS peak, max(cap)::BIGINT AS cap, sum(CASE WHEN lvl > cap THEN st ELSE 0 END)::BIGINT AS starts_over FROM l GROUP BY ALL"""


RUN_LIMITS = {"user": "max_run_per_user", "project": "max_run_per_project", "queue": "max_nodes_total"}
HELD_LIMITS = {"user": "max_queued_per_user", "project": "max_queued_per_project"}


@query("j12_cap_audit_running", audit_sql("start_h", RUN_LIMITS))
def _(s, d):
    return L.cap_audit(X.jobs(s, d), X.queues(s))


@query("j12_cap_audit_queued", audit_sql("submit_h", HELD_LIMITS))
def _(s, d):
    return L.cap_audit(X.jobs(s, d), X.queues(s), start="submit_h", limits=HELD_LIMITS)


@query("j13_pending", """
SELECT o_orderkey, n FROM (SELECT o_orderkey, 1 + o_orderkey % 7 AS n FROM orders) o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = o.n)""")
def _(s, d):
    tasks = X.table(s, d, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 7).alias("n"))
    done = X.table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("n"))
    return tables.pending(tasks, done, ["o_orderkey", "n"])
