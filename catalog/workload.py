"""Workload profile and seeded sampling (A15-A21, R1-R5)."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.lookups import AFFECTED
from catalog.registry import query, rnd
from nodehours.functions.constants import SCENARIOS
from nodehours.operators import sampling as R
from nodehours.operators import workload as W


def uni(*parts: str) -> str:
    """SQL of the reproducible uniform draw."""
    return "(('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def burn_sql(cover: float = 0.4, floor: float = 0.4) -> str:
    """The sequential smoothing written out month by month."""
    low = (f"SELECT *, (SELECT count(*) FROM unnest([{', '.join(f'n{i}' for i in range(12))}]) t(x) WHERE x > 0) AS npres,"
           f" (SELECT median(x) FROM unnest([{', '.join(f'n{i}' for i in range(12))}]) t(x) WHERE x > 0) AS med FROM raw")
    steps = [
        "per AS (SELECT program, alloc_off, sum(nodes * runtime_h) AS nh, count(*) AS n FROM offs_fx GROUP BY ALL)",
        "av AS (SELECT program, avg(nh) AS a FROM per GROUP BY program)",
        "raw AS (SELECT p.program, " + ", ".join(
            f"coalesce(max(nh / a) FILTER (WHERE alloc_off = {i}), 1.0) AS m{i}, coalesce(max(n) FILTER (WHERE alloc_off = {i}), 0) AS n{i}" for i in range(12))
        + " FROM per p JOIN av USING (program) GROUP BY p.program)",
        f"lw AS ({low})",
        "s0 AS (SELECT *, " + ", ".join(f"(n{i} < med * {cover} OR (n{i} > 0 AND m{i} < {floor})) AND npres > 2 AS low{i}" for i in range(12)) + " FROM lw)"]
    for i in range(12):
        steps.append(f"s{i + 1} AS (SELECT * REPLACE (CASE WHEN low{i} THEN (m{(i - 1) % 12} + m{(i + 1) % 12}) / 2 ELSE m{i} END AS m{i}) FROM s{i})")
    pres = " + ".join(f"CASE WHEN n{i} > 0 THEN m{i} ELSE 0 END" for i in range(12))
    steps.append(f"nm AS (SELECT *, ({pres}) / npres AS avgm FROM s12)")
    rows = " UNION ALL ".join(f"SELECT program, {i} AS alloc_off, CASE WHEN n{i} > 0 THEN m{i} / avgm ELSE m{i} END AS mult FROM nm" for i in range(12))
    steps.append(f"burn AS ({rows})")
    return ",\n".join(steps)


@query("a15_burn_curve", f"""WITH {burn_sql()}
SELECT program, alloc_off, (((alloc_off + start_month - 1) % 12) + 1)::INTEGER AS cal_month, round(mult, 8) AS mult FROM burn JOIN programs_fx USING (program)""")
def _(s, d):
    return rnd(W.burn_curve(X.order_jobs(s, d), X.programs(s)), 8)


@query("a15_burn_curve_unseen", f"""WITH {burn_sql()}
SELECT program, alloc_off, (((alloc_off + start_month - 1) % 12) + 1)::INTEGER AS cal_month, round(mult, 8) AS mult FROM burn JOIN programs_fx USING (program)
UNION ALL SELECT 'D', i::INTEGER, ((i + 3) % 12 + 1)::INTEGER, 1.0 FROM range(12) AS r(i)""")
def _(s, d):
    more = X.programs(s).unionByName(s.createDataFrame([("D", 0.1, 4, None)], X.programs(s).schema))
    return rnd(W.burn_curve(X.order_jobs(s, d), more), 8)


@query("a15_burn_curve_raw", f"""WITH {burn_sql(0, 0)} SELECT program, alloc_off, (((alloc_off + start_month - 1) % 12) + 1)::INTEGER AS cal_month, round(mult, 8) AS mult FROM burn JOIN programs_fx USING (program)""")
def _(s, d):
    return rnd(W.burn_curve(X.order_jobs(s, d), X.programs(s), 0, 0), 8)


def scenario_sql(name: str, seed: int, src: str = "jobs_fx", ident: str = "job_id") -> str:
    nodes, walls, mean, spread = SCENARIOS[name]

    def case(mix, u, cast):
        # the shares as they stand in the mix, summed by SQL
        edge = lambda i: "(" + " + ".join(f"{w}::DOUBLE / ({' + '.join(f'{x}::DOUBLE' for _, x in mix)})" for _, w in mix[:i + 1]) + ")"
        return "CASE " + " ".join(f"WHEN {u} < {edge(i)} THEN {v}" for i, (v, _) in enumerate(mix[:-1])) + f" ELSE {mix[-1][0]} END::{cast}"

    def u(k):
        return uni(f"{ident}::VARCHAR", f"'{k}{seed}'")

    z = f"sqrt(-2 * ln(1 - {u('a')})) * cos(2 * pi() * {u('b')})"
    return (f"SELECT *, least(greatest(rt_ratio * walltime_h, 0.05), walltime_h) AS runtime_h FROM (SELECT {ident} AS req_id, {case(nodes, u('n'), 'INTEGER')} AS nodes, "
            f"{case(walls, u('w'), 'DOUBLE')} AS walltime_h, least(greatest({mean}::DOUBLE + {spread}::DOUBLE * {z}, 0.05), 1.0) AS rt_ratio FROM {src})")


def req(s, d):
    return X.jobs(s, d).select(F.col("job_id").alias("req_id"))


@query("a17_rate_from_share", f"""
SELECT round(avg(nodes * walltime_h * rt_ratio), 6) AS mean_nh, round(0.15 * 10624 * 8760 / avg(nodes * walltime_h * rt_ratio) / (8760 * 0.75), 8) AS rate_h FROM ({scenario_sql('ai_default', 5)})""")
def _(s, d):
    t = W.rate_from_share(R.scenario_draws(req(s, d), "ai_default", 5), 0.15, 10624, 0.75)
    return t.select(F.round("mean_nh", 6).alias("mean_nh"), F.round("rate_h", 8).alias("rate_h"))


@query("a19_cell_profile", "SELECT program, alloc_off, size_tier, count(*) AS n, count(*) < 20 AS thin FROM offs_fx GROUP BY program, alloc_off, size_tier")
def _(s, d):
    return W.cell_profile(X.order_jobs(s, d), X.programs(s))


SPAN = "(SELECT (epoch_us(max(submit_time)) - epoch_us(min(submit_time))) / 3.6e9::DOUBLE FROM ordjobs_fx)"


@query("a20_project_profile", f"""
WITH p AS (SELECT program, project, count(*) AS n, sum(nodes * runtime_h) AS nh FROM ordjobs_fx GROUP BY ALL),
f AS (SELECT program, CASE WHEN n >= 140 THEN project ELSE program || '_misc' END AS project, sum(n)::BIGINT AS n, sum(nh) AS nh FROM p GROUP BY 1, 2)
SELECT program, project, n, round(n / {SPAN} * 0.6, 9) AS rate_h, round(nh, 4) AS delivered_nh, round(nh * 1.15, 4) AS award_nh FROM f""")
def _(s, d):
    j = X.order_jobs(s, d)
    t = W.project_profile(j, W.span_hours(j), 140, 1.15, 0.6)
    return t.select("program", "project", "n", F.round("rate_h", 9).alias("rate_h"), F.round("delivered_nh", 4).alias("delivered_nh"), F.round("award_nh", 4).alias("award_nh"))


@query("a21_base_rates", f"SELECT program, count(*) AS n, round(count(*) / {SPAN} * 0.8, 9) AS rate_h FROM ordjobs_fx GROUP BY program")
def _(s, d):
    j = X.order_jobs(s, d)
    return rnd(W.base_rates(j, W.span_hours(j), 0.8), 9)


def requests(s, d):
    return X.jobs(s, d).select(F.col("job_id").alias("req_id"), "program", (F.col("k") % 12).cast("int").alias("alloc_off"))


@query("r1_bootstrap", f"""
WITH cell AS (SELECT program, alloc_off, size_tier, count(*) AS n FROM offs_fx GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY program, alloc_off ORDER BY size_tier) AS upto, sum(n) OVER (PARTITION BY program, alloc_off) AS tot FROM cell),
rq AS (SELECT job_id AS req_id, program, k % 12 AS alloc_off, {uni("job_id::VARCHAR", "'cell7'")} AS uc, {uni("job_id::VARCHAR", "'row7'")} AS ur FROM jobs_fx),
pk AS (SELECT rq.*, c.size_tier, c.n FROM rq LEFT JOIN cum c ON c.program = rq.program AND c.alloc_off = rq.alloc_off AND floor(uc * c.tot) < c.upto AND floor(uc * c.tot) >= c.upto - c.n),
ix AS (SELECT *, row_number() OVER (PARTITION BY program, alloc_off, size_tier ORDER BY job_id) AS ci, row_number() OVER (PARTITION BY program ORDER BY job_id) AS pi FROM offs_fx),
pn AS (SELECT program, count(*) AS pn FROM offs_fx GROUP BY program),
hit AS (SELECT pk.req_id, i.job_id AS source_id, i.nodes, i.walltime_h, i.rt_ratio, 'cell' AS pool FROM pk JOIN ix i ON i.program = pk.program AND i.alloc_off = pk.alloc_off AND i.size_tier = pk.size_tier AND i.ci = floor(ur * pk.n) + 1 WHERE pk.n >= 60
 UNION ALL SELECT pk.req_id, i.job_id, i.nodes, i.walltime_h, i.rt_ratio, 'program' FROM pk JOIN pn USING (program) JOIN ix i ON i.program = pk.program AND i.pi = floor(ur * pn) + 1 WHERE pk.n IS NULL OR pk.n < 60)
SELECT req_id, source_id, nodes, pool, round(least(greatest(rt_ratio * walltime_h, 0.05), walltime_h), 10) AS runtime_h FROM hit""")
def _(s, d):
    prof = W.with_offset(X.order_jobs(s, d), X.programs(s))
    t = R.bootstrap(requests(s, d), prof, 60, 7)
    return rnd(t.select("req_id", "source_id", "nodes", "pool", "runtime_h"), 10)


@query("r1_bootstrap_replicates", f"""
WITH cell AS (SELECT program, alloc_off, size_tier, count(*) AS n FROM offs_fx GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY program, alloc_off ORDER BY size_tier) AS upto, sum(n) OVER (PARTITION BY program, alloc_off) AS tot FROM cell),
rq AS (SELECT job_id AS req_id, design, seed, program, ((k + 5 * design) % 12)::INTEGER AS alloc_off, {uni("design::VARCHAR", "job_id::VARCHAR", "'cell' || seed::VARCHAR")} AS uc,
 {uni("design::VARCHAR", "job_id::VARCHAR", "'row' || seed::VARCHAR")} AS ur FROM jobs_fx, (VALUES (0), (1)) AS d(design), (VALUES (7), (8), (23)) AS r(seed)),
pk AS (SELECT rq.*, c.size_tier, c.n FROM rq LEFT JOIN cum c ON c.program = rq.program AND c.alloc_off = rq.alloc_off AND floor(uc * c.tot) < c.upto AND floor(uc * c.tot) >= c.upto - c.n),
ix AS (SELECT *, row_number() OVER (PARTITION BY program, alloc_off, size_tier ORDER BY job_id) AS ci, row_number() OVER (PARTITION BY program ORDER BY job_id) AS pi FROM offs_fx),
pn AS (SELECT program, count(*) AS pn FROM offs_fx GROUP BY program)
SELECT pk.design, pk.seed, pk.req_id, i.job_id AS source_id, i.nodes, 'cell' AS pool FROM pk JOIN ix i ON i.program = pk.program AND i.alloc_off = pk.alloc_off AND i.size_tier = pk.size_tier AND i.ci = floor(ur * pk.n) + 1 WHERE pk.n >= 60
 UNION ALL SELECT pk.design, pk.seed, pk.req_id, i.job_id, i.nodes, 'program' FROM pk JOIN pn USING (program) JOIN ix i ON i.program = pk.program AND i.pi = floor(ur * pn) + 1 WHERE pk.n IS NULL OR pk.n < 60""")
def _(s, d):
    pools = R.cell_pools(W.with_offset(X.order_jobs(s, d), X.programs(s)))
    rq = X.jobs(s, d).withColumn("design", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.col("job_id").alias("req_id"), "design", "program", ((F.col("k") + 5 * F.col("design")) % 12).cast("int").alias("alloc_off"))
    return R.bootstrap(rq, None, 60, [7, 8, 23], ["design", "req_id"], pools=pools).select("design", "seed", "req_id", "source_id", "nodes", "pool")


@query("r2_bootstrap_project_replicates", f"""
WITH ix AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY job_id) AS i, count(*) OVER (PARTITION BY project) AS n FROM ordjobs_fx)
SELECT seed, j.job_id AS req_id, ix.job_id AS source_id, ix.nodes FROM jobs_fx j CROSS JOIN (VALUES (9), (10), (31)) AS r(seed)
JOIN ix ON ix.project = j.project AND ix.i = floor({uni("j.job_id::VARCHAR", "'row' || seed::VARCHAR")} * ix.n) + 1""")
def _(s, d):
    rq = X.jobs(s, d).select(F.col("job_id").alias("req_id"), "project")
    return R.bootstrap_project(rq, X.order_jobs(s, d), [9, 10, 31]).select("seed", "req_id", "source_id", "nodes")


@query("r2_bootstrap_project", f"""
WITH ix AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY job_id) AS i, count(*) OVER (PARTITION BY project) AS n FROM ordjobs_fx)
SELECT j.job_id AS req_id, ix.job_id AS source_id, ix.nodes, round(least(greatest(ix.rt_ratio * ix.walltime_h, 0.05), ix.walltime_h), 10) AS runtime_h
FROM jobs_fx j JOIN ix ON ix.project = j.project AND ix.i = floor({uni("j.job_id::VARCHAR", "'row9'")} * ix.n) + 1""")
def _(s, d):
    rq = X.jobs(s, d).select(F.col("job_id").alias("req_id"), "project")
    return rnd(R.bootstrap_project(rq, X.order_jobs(s, d), 9).select("req_id", "source_id", "nodes", "runtime_h"), 10)


for _name in SCENARIOS:
    @query(f"r3_scenario_{_name}", f"SELECT req_id, nodes, walltime_h, round(rt_ratio, 7) AS rt_ratio, round(runtime_h, 6) AS runtime_h FROM ({scenario_sql(_name, 3)})")
    def _(s, d, name=_name):
        t = R.scenario_draws(req(s, d), name, 3)
        return t.select("req_id", "nodes", "walltime_h", F.round("rt_ratio", 7).alias("rt_ratio"), F.round("runtime_h", 6).alias("runtime_h"))


RATES = """
rt AS (SELECT project, min(program) AS program, count(*) / 720.0::DOUBLE AS rate_h FROM jobs_fx GROUP BY project),
g AS (SELECT rt.*, range AS bin, range * 12.0::DOUBLE AS t_h, ((((2 - 1 + floor(floor(range * 12 / 24) / 30)::BIGINT) % 12) + 1 - start_month + 12) % 12)::INTEGER AS alloc_off FROM rt JOIN programs_fx USING (program), range(180)),
ex AS (SELECT g.project, g.program, g.bin, g.t_h, g.alloc_off, g.rate_h * b.mult * coalesce((SELECT product(mult) FROM deadlines_fx w JOIN aff a ON a."window" = w.name WHERE a.project = g.project AND g.t_h BETWEEN w.s AND w.e), 1.0) * 1.3 * 12 AS expected
 FROM g JOIN burn b ON b.program = g.program AND b.alloc_off = g.alloc_off)"""


def expected(s, d):
    j = X.jobs(s, d)
    rates = j.groupBy("project").agg(F.min("program").alias("program"), (F.count(F.lit(1)) / 720.0).alias("rate_h"))
    rates = rates.join(X.programs(s).select("program", "start_month"), "program")
    aff = R.affected_projects(j.select("project").distinct(), [w[0] for w in X.DEADLINES], 0.4, 11)
    curve = W.burn_curve(X.order_jobs(s, d), X.programs(s))
    return R.expected_arrivals(rates, curve, 2160.0, 12.0, 2, "project", X.DEADLINES, aff, 1.3)


@query("r4_expected_arrivals", f"""WITH {burn_sql()}, {AFFECTED.strip()}, {RATES.strip()}
SELECT project, bin, alloc_off, round(expected, 8) AS expected FROM ex""")
def _(s, d):
    return rnd(expected(s, d).select("project", "bin", "alloc_off", "expected"), 8)


@query("r4_draw_arrivals", f"""WITH {burn_sql()}, {AFFECTED.strip()}, {RATES.strip()},
sl AS (SELECT ex.*, seed, ceil(expected)::BIGINT AS k FROM ex, (VALUES (1), (2)) AS v(seed) WHERE expected > 0),
su AS (SELECT sl.*, s, expected / k AS lam, {uni("project", "bin::VARCHAR", "s::VARCHAR", "seed::VARCHAR", "'count'")} AS u FROM sl, LATERAL (SELECT unnest(range(k)) AS s)),
cdf AS (SELECT *, (SELECT count(*) FROM (SELECT sum(exp(-lam) * pow(lam, i) / factorial(i::INTEGER)) OVER (ORDER BY i) AS c FROM range(20) t(i)) WHERE u >= c) AS n FROM su)
SELECT project, seed, alloc_off, round(t_h + 12.0::DOUBLE / k * (s + {uni("project", "bin::VARCHAR", "s::VARCHAR", "j::VARCHAR", "seed::VARCHAR", "'time'")}), 6) AS submit_h
FROM cdf, LATERAL (SELECT unnest(range(1, n + 1)) AS j)""")
def _(s, d):
    t = R.draw_arrivals(expected(s, d), [1, 2], "project")
    return rnd(t.select("project", "seed", "alloc_off", "submit_h"), 6)


def cap_sql(n: str) -> str:
    return f"(CASE WHEN {n} >= 1920 THEN 24.0 WHEN {n} >= 512 THEN 8.0 WHEN {n} >= 1 THEN 4.0 END)::DOUBLE"


@query("r5_respond", f"""
WITH j AS (SELECT job_id, program, nodes, walltime_h AS w, runtime_h AS r, {uni("job_id::VARCHAR", "'21'")} AS u, {cap_sql('nodes')} AS cap0 FROM jobs_fx),
b AS (SELECT *, (SELECT min(min_nodes) FROM breakpoints_fx x WHERE x.cap >= w AND x.min_nodes <= 2500) AS lo FROM j),
n AS (SELECT *, CASE WHEN w >= 2.0 AND u < CASE WHEN program = 'A' THEN 0.9 ELSE 0.5 END AND cap0 < w AND lo IS NOT NULL AND greatest(lo, nodes) <= 2500 THEN greatest(lo, nodes) ELSE nodes END AS n2 FROM b),
c AS (SELECT *, {cap_sql('n2')} AS cap FROM n)
SELECT job_id, n2::INTEGER AS nodes, {X.TIER_CASE.replace('nodes', 'n2')} AS size_tier, least(w, cap) AS walltime_h, round(least(CASE WHEN w > cap THEN r / w * cap ELSE r END, least(w, cap)), 7) AS runtime_h, n2 <> nodes AS resized FROM c""")
def _(s, d):
    t = R.respond(X.jobs(s, d).select("job_id", "program", "nodes", "walltime_h", "runtime_h"), X.BREAKPOINTS, 21, 0.5,
                  {"A": 0.9}, 2500, 2.0, ident="job_id")
    return t.select("job_id", "nodes", "size_tier", "walltime_h", F.round("runtime_h", 7).alias("runtime_h"), "resized")
