"""Exact expected values on tiny tables, and the contract cases that have no whole-table query."""

import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from nodehours import blocks as B
from nodehours.functions import clean as C
from nodehours.functions import score as S
from nodehours.operators import experiments as E
from nodehours.operators import findings as N
from nodehours.operators import lookups as L
from nodehours.operators import priority as P
from nodehours.operators import sampling as R
from nodehours.operators import series as T
from nodehours.operators import stats as A
from nodehours.sources import tables, trace


@pytest.fixture(params=["2", "1000000"], ids=["blocks", "one block"])
def both(spark, request):
    """The session once with tiny blocks, once with all rows in one block."""
    spark.conf.set("nodehours.blockRows", request.param)
    yield spark
    spark.conf.unset("nodehours.blockRows")


def intervals(spark, rows):
    return spark.createDataFrame(rows, "start_h double, end_h double, nodes int")


def test_timeline_whole_and_partial_bins(spark):
    tl = T.busy_timeline(intervals(spark, [(0.0, 2.0, 10), (1.0, 3.0, 20)]), 0, 4, 1)
    assert [r.busy_nodes for r in tl.orderBy("t_h").collect()] == [10, 30, 20, 0]
    tl = T.busy_timeline(intervals(spark, [(0.5, 1.25, 10)]), 0, 2, 1)
    assert [r.busy_nodes for r in tl.orderBy("t_h").collect()] == pytest.approx([5, 2.5])
    assert T.utilization(intervals(spark, [(0.0, 4.0, 50)]), 0, 4, 100).first().utilization == pytest.approx(0.5)
    # the timeline and the clipped sum agree, also with a partial last bin
    iv = intervals(spark, [(-1.0, 2.5, 3), (2.0, 9.0, 5), (4.1, 4.2, 7)])
    total = T.busy_timeline(iv, 0, 5.3, 1).agg(F.sum("node_hours")).first()[0]
    assert total == pytest.approx(T.utilization(iv, 0, 5.3, 1).first().node_hours)


def test_wait_summary_with_censored_and_empty(both):
    rows = [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (None, 10.0)]
    s = A.wait_summary(both.createDataFrame(rows, "wait_h double, wait_lb_h double")).first()
    assert (s.n_started, s.n_censored) == (3, 1) and s.lb_p95_h > s.started_p95_h
    e = A.wait_summary(both.createDataFrame([(None, 4.0)], "wait_h double, wait_lb_h double")).first()
    assert e.n_started == 0 and e.started_p50_h is None and e.started_mean_h is None


def test_compare_identical_pairs(both):
    df = both.range(100).select(F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    c = A.compare(df, "a", "b").first()
    assert c.ks == 0 and c.log2_ratio_p50 == 0 and c.spearman == pytest.approx(1) and c.n == 100


def test_fitted_score_values(spark):
    cols = "nodes int, walltime_h double, submit_h double, project_priority double, enable_wfp double, enable_fifo double"
    df = C.fill_scoring(spark.createDataFrame([(1024, 12.0, 0.0, 25.0, 1.0, 0.0), (1, 1.0, 0.0, 25.0, 0.0, 1.0)], cols))
    s = [r.s for r in df.select("nodes", S.score_fitted(S.eligible(10.0)).alias("s")).orderBy(F.desc("nodes")).collect()]
    assert s == pytest.approx([51 + 25 * 1024 / 10624 * 3.6 ** 2, 61.0])
    late = df.where("nodes = 1").withColumn("since", F.lit(8.0)).select(S.score_fitted(S.eligible(10.0, "since")).alias("s"))
    assert late.first().s == pytest.approx(53.0)


def test_user_formula_rejects_unknown_names(spark):
    df = spark.createDataFrame([(0.0, 5.0), (2.0, 5.0)], "a double, b double").withColumn("secret", F.lit(1))
    out = S.score_expr(df, "if(a > 1, a, b) + least(a, b)", ["a", "b"])
    assert [r.score for r in out.orderBy("a").collect()] == [5.0, 4.0]
    with pytest.raises(ValueError):
        S.score_expr(df, "a + secret", ["a", "b"])


def test_queue_dimension_and_routing(spark):
    ddl = ("name string, queue_type string, min_nodes int, max_nodes int, max_walltime_h double, max_run_per_user double, "
           "max_queued_per_project double, from_route_only boolean")
    q = C.queue_dim(spark.createDataFrame([("small", "Execution", 256, 1024, 12.0, None, 10.0, True),
                                           ("R123", "Execution", None, None, None, None, None, False)], ddl))
    row = q.collect()
    assert [r.name for r in row] == ["small"] and row[0].max_run_per_user is None and row[0].max_queued_per_project == 10
    jobs = spark.createDataFrame([(512, 6.0), (512, 24.0)], "nodes int, walltime_h double")
    assert {r.walltime_h: r.routed for r in L.route(jobs, q).collect()} == {6.0: "small", 24.0: None}


def test_earliest_fit_brute_force(both):
    prof = [(0.0, 5.0), (1.0, 10.0), (2.0, 3.0), (4.0, 12.0), (7.0, 2.0), (8.0, 20.0), (9.0, 30.0)]
    reqs = [(n, w) for n in (1, 3, 4, 10, 12, 20, 25, 99) for w in (0.5, 1.0, 2.0, 3.0, 4.5, 50.0)]

    def brute(n, w):
        ts = [t for t, _ in prof]
        for k in range(len(prof) - 1):
            k1 = max(sum(t < ts[k] + w - 1e-9 for t in ts), k + 1)
            if min(f for _, f in prof[k:k1]) >= n:
                return ts[k]
        return None

    out = L.earliest_fit(both.createDataFrame(reqs, "nodes int, walltime_h double"), both.createDataFrame(prof, "t_h double, free double"))
    got = {(r.nodes, r.walltime_h): r.fit_h for r in out.collect()}
    assert got == {(n, w): brute(n, w) for n, w in reqs}


def test_cap_audit_releases_before_starts(both):
    jobs = both.createDataFrame([("q", "u", "p", 4, 0.0, 1.0), ("q", "u", "p", 4, 1.0, 2.0), ("q", "v", "p", 4, 1.5, 3.0)],
                                 "queue string, user string, project string, nodes int, start_h double, end_h double")
    q = both.createDataFrame([("q", 1, 1, 100)], "name string, max_run_per_user int, max_run_per_project int, max_nodes_total int")
    got = {(r.scope, r.entity): (r.peak, r.starts_over) for r in L.cap_audit(jobs, q).collect()}
    assert got == {("user", "u"): (1, 0), ("user", "v"): (1, 0), ("project", "p"): (2, 1), ("queue", "*"): (8, 0)}


def test_availability_windows_and_step_series(both):
    series = both.createDataFrame([(0.0, 30.0), (5.0, 100.0)], "t_h double, up double")
    a = {r.t_h: r.available for r in T.availability(series, intervals(both, [(10.0, 14.0, 100)]), 100).collect()}
    assert a == {0.0: 30.0, 5.0: 100.0, 10.0: 0.0, 14.0: 100.0}


def test_snapshot_ranks_every_pending_job(both):
    rows = [(i, float(i % 3), 50.0 if i % 2 else None, 8) for i in range(40)]
    jobs = both.createDataFrame(rows, "job_id long, submit_h double, start_h double, nodes int")
    out = P.queue_snapshot(jobs, [1.0, 60.0], S.score_fifo).collect()
    by = {t: sorted((r for r in out if r.t_h == t), key=lambda r: r["rank"]) for t in (1.0, 60.0)}
    assert len(by[1.0]) == 27 and len(by[60.0]) == 20
    for rs in by.values():
        assert [r["rank"] for r in rs] == list(range(1, len(rs) + 1))
        key = [(-r.score, r.submit_h, r.job_id) for r in rs]
        assert key == sorted(key)


def test_bootstrap_rows_exist_and_pools_are_respected(both):
    prof = both.createDataFrame([(i, "A" if i % 3 else "B", i % 4, "small" if i % 5 else "large", i + 1, 2.0, 0.5) for i in range(300)],
                                 "job_id long, program string, alloc_off int, size_tier string, nodes int, walltime_h double, rt_ratio double")
    req = both.range(500).select(F.col("id").alias("req_id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("program"),
                                  (F.col("id") % 5).cast("int").alias("alloc_off"))
    out = R.bootstrap(req, prof, 10, 1).join(prof.select(F.col("job_id").alias("source_id"), F.col("program").alias("p"), F.col("alloc_off").alias("o")), "source_id")
    rows = out.collect()
    assert len(rows) == 500 and all(r.program == r.p for r in rows)
    assert all(r.o == r.alloc_off for r in rows if r.pool == "cell") and all(r.pool == "program" for r in rows if r.alloc_off == 4)


def test_latin_hypercube_has_one_point_per_stratum(spark):
    pts = E.latin_hypercube(spark, {"x": (0.0, 1.0), "y": (10.0, 20.0)}, {"c": ["a", "b"]}, 50, 9).collect()
    assert sorted(math.floor(r.x * 50) for r in pts) == list(range(50))
    assert sorted(math.floor((r.y - 10) * 5) for r in pts) == list(range(50)) and {r.c for r in pts} == {"a", "b"}


def test_poisson_draws_follow_the_rate(spark):
    ex = spark.createDataFrame([("e", 0, 0.0, 0, 10.0, 2000.0), ("f", 0, 0.0, 0, 10.0, 0.5)],
                               "program string, bin long, t_h double, alloc_off int, width_h double, expected double")
    rows = R.draw_arrivals(ex, list(range(40)), "program").groupBy("program").agg(
        F.count("*").alias("n"), F.avg("submit_h").alias("m"), F.min("submit_h").alias("lo"), F.max("submit_h").alias("hi")).collect()
    r = {x.program: x for x in rows}
    assert abs(r["e"].n - 80000) < 4 * 80000 ** 0.5 and abs(r["e"].m - 5) < 0.05 and r["e"].lo >= 0 and r["e"].hi < 10
    assert 4 < r["f"].n < 45


def test_score_regression_recovers_exponents(spark):
    from nodehours.operators.findings import score_regression

    df = spark.range(1, 400).select((F.col("id") * 1.5).alias("e"), (1 + F.col("id") % 37).cast("double").alias("n"))
    df = df.withColumn("s", 3.0 * F.pow("e", F.lit(2.0)) * F.col("n"))
    got = {r.term: r.coefficient for r in score_regression(df, "s", ["e", "n"]).collect()}
    assert got["e"] == pytest.approx(2) and got["n"] == pytest.approx(1) and got["intercept"] == pytest.approx(math.log(3))


def test_lenient_parsers(spark):
    rows = [("30:15:36", "Mon Mar 02 10:11:12 2026", "[u:X=2][p:Y=10][o:Z=128]"), ("1:2", "Mon Mxx 02 10:11:12 2026", "[u:X=a]"), (None, "", None)]
    df = spark.createDataFrame(rows, "h string, t string, l string")
    out = df.select(C.hms_hours("h").alias("h"), C.hms_hours("h", True).alias("h2"), C.ts_weekday("t").cast("string").alias("t"),
                    C.parse_limit("l", "u").alias("u"), C.parse_limit("l", "o").alias("o")).collect()
    assert out[0].h == pytest.approx(30.26) and out[1].h is None and out[1].h2 == pytest.approx(1 / 60 + 2 / 3600)
    assert [r.t for r in out] == ["2026-03-02 10:11:12", None, None]
    assert (out[0].u, out[0].o, out[1].u, out[2].u) == (2.0, 128.0, None, None)


def test_hours_do_not_depend_on_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10 02:30:00",)], "t string")
        assert df.select(C.hours_since(C.ts_lenient("t"), "2024-03-10").alias("h")).first().h == pytest.approx(2.5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_hash_ignores_column_order(spark):
    df = spark.createDataFrame([(1, "x", "out1")], "a int, b string, dir string")
    one = df.select(C.config_hash(["a", "b"]).alias("h")).first().h
    assert one == df.withColumn("dir", F.lit("other")).select(C.config_hash(["b", "a"]).alias("h")).first().h and len(one) == 12


def test_profile_version_is_checked(spark, tmp_path):
    spark.range(1).select(F.lit(99).alias("version"), F.lit(1.0).alias("span_h")).write.parquet(f"{tmp_path}/meta")
    with pytest.raises(ValueError, match="version"):
        tables.read_profile(spark, str(tmp_path))


def test_required_trace_table_must_exist(spark, tmp_path):
    with pytest.raises(AnalysisException):
        trace.load_trace(spark, str(tmp_path))


def test_large_dimension_is_not_broadcast(spark):
    dim = spark.range(50)
    assert "broadcast" in B.small_side(dim)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in B.small_side(dim, 10)._jdf.queryExecution().logical().toString().lower()
    with pytest.raises(ValueError):
        B.dim_rows(dim, ["id"], 10)


def test_window_filters_reach_the_parquet_scan(spark, tmp_path):
    intervals(spark, [(0.0, 2.0, 10), (50.0, 60.0, 20)]).write.parquet(f"{tmp_path}/iv")
    df = spark.read.parquet(f"{tmp_path}/iv")
    for out in (T.utilization(df, 10.0, 20.0, 100), T.busy_timeline(df, 10.0, 20.0, 1.0)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "LessThan(start_h,20.0)" in plan and "GreaterThan(end_h,10.0)" in plan
    assert T.utilization(df, 10.0, 20.0, 100).first().node_hours == 0.0


@pytest.mark.parametrize("bad", ["__import__('os')", "a.b", "x[0]", "lambda: 1", "1 if a else 2", "a and b", "'s'*3", "rand()", "a + c",
                                 "java_method('java.lang.System', 'nanoTime')", "(select max(a))", "reflect('x', 'y')", "a || b"])
def test_formula_refuses_all_but_arithmetic(spark, bad):
    df = spark.createDataFrame([(0.0, 5.0, 1.0), (2.0, 4.0, 1.0)], "a double, b double, x double")
    with pytest.raises(ValueError):
        S.score_expr(df, bad, ["a", "b", "x"])
    good = S.score_expr(df, "if(a > 1, a, b) + least(a, b)", ["a", "b"])
    assert sorted(r.score for r in good.collect()) == [4.0, 5.0]


def test_bootstrap_on_text_ids_keeps_requests_without_a_pool(both):
    profile = both.createDataFrame([(f"job.{i}", "p", 0, "s", 4, 2.0, 0.5) for i in range(9)],
                                   "job_id string, program string, alloc_off int, size_tier string, nodes int, walltime_h double, rt_ratio double")
    req = both.createDataFrame([(i, "p" if i % 3 else "none", 0) for i in range(30)], "req_id long, program string, alloc_off int")
    out = {r.req_id: r for r in R.bootstrap(req, profile, 1, 5).collect()}
    assert len(out) == 30 and all((r.source_id is None) == (r.program == "none") for r in out.values())
    again = {r.req_id: r for r in R.bootstrap(req.repartition(7), profile.repartition(5), 1, 5).collect()}
    assert again == out


def test_bootstrap_from_a_written_profile(spark, tmp_path):
    fit = spark.createDataFrame([(f"job.{i}", "p", "q", 4 + i % 3, 2.0, 0.5, 1.0, 1 + i % 2) for i in range(12)],
                                "job_id string, program string, project string, nodes int, walltime_h double, rt_ratio double, runtime_h double, cal_month int")
    fit = fit.withColumn("submit_time", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    rows, span = tables.read_profile(spark, tables.write_profile(fit, str(tmp_path / "profile")))
    assert span == 0 and rows.count() == 12
    req = spark.range(20).select(F.col("id").alias("req_id"), F.lit("p").alias("program"), (F.col("id") % 2).cast("int").alias("alloc_off"))
    out = R.bootstrap(req, rows.withColumn("alloc_off", F.col("cal_month") - 1), 1, 3).collect()
    ids = {r.job_id: r.cal_month for r in fit.collect()}
    assert len(out) == 20 and all(ids[r.source_id] - 1 == r.alloc_off for r in out)


def test_upsert_needs_an_order(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        tables.upsert(df, df, ["k"], [])


def test_deadlines_become_windows(spark):
    calendar = spark.createDataFrame([("a", 3, 11, 5, 2.0), ("b", 1, 1, 2, 1.5), ("c", 2, 1, 3, 1.2)], "name string, month int, day int, lead_days int, mult double")
    got = R.deadline_windows(calendar, start_month=2, days=400)
    assert sorted(map(tuple, got.collect())) == [("a", (30 + 10 - 5) * 24.0, (30 + 10) * 24.0, 2.0),
                   ("a+1", (365 + 35) * 24.0, (365 + 40) * 24.0, 2.0), ("b", (330 - 2) * 24.0, 330 * 24.0, 1.5),
                   ("c", 0.0, 0.0, 1.2), ("c+1", (365 - 3) * 24.0, 365 * 24.0, 1.2)]


def test_usable_series_without_coverage_is_constant(spark):
    snaps = spark.createDataFrame([(30.0, 90.0), (-100.0, 5.0)], "t_h double, up double")
    jobs = spark.createDataFrame([(0.0, 2.0, 4)], "start_h double, end_h double, nodes int")
    none = jobs.where("nodes < 0")
    late = T.usable_series(snaps, jobs, none, 4.0, 6.0, 1.0, otherwise=77.0).collect()
    assert [(r.bin, r.t_h, r.usable) for r in late] == [(i, float(i), 77.0) for i in range(5)]
    covered = T.usable_series(snaps.where("t_h > 0").withColumn("t_h", F.col("t_h") - 30), jobs, none, 4.0, 6.0, 1.0, otherwise=77.0).collect()
    assert {r.usable for r in covered} == {90.0}


def test_asof_in_a_long_dimension_does_not_move_the_rows(spark):
    steps = spark.range(200_000).select((F.col("id") * 0.5).alias("t_h"), (F.col("id") % 977).cast("double").alias("up"))
    rows = spark.range(50_000).select("id", ((F.col("id") * 7919) % 100_050 - 20 + (F.col("id") % 2) * 0.25).alias("at"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None)], "id long, at double"))
    out = L.asof_step(rows, steps, "at", "up", dimension=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    for r in out.collect():
        want = None if r.at is None else min(max(int(r.at // 0.5), 0), 199_999) % 977
        assert r.up == want, r
    none = L.asof_step(rows.limit(3), steps.limit(0), "at", "up", dimension=True)
    assert [r.up for r in none.collect()] == [None] * 3


@pytest.mark.parametrize("size", [256, 4])
def test_an_opening_of_a_minute_counts(both, monkeypatch, size):
    from nodehours import blocks
    monkeypatch.setattr(blocks, "ARRAY_ROWS", size)
    minute = 1 / 60
    jobs = [("a", 0.0, 0.0, 10.0, 60), ("b", 0.0, 0.0, 10.1, 40), ("c", 0.5, 0.5, 0.5, 7), ("d", 1.0, 20.0, 21.0, 100),
            ("e", 10.0, 10.0 + minute, 30.0, 60), ("f", 9.0, 9.5, 9.6, 0), ("g", 11.0, 12.0, None, 1), ("h", 5.0, None, None, 5), ("i", 25.0, 24.0, 26.0, 3)]
    rng = np.random.default_rng(1)
    for k in range(120):
        s = float(rng.integers(0, 200)) / 4
        jobs.append((f"r{k}", s, s + float(rng.integers(0, 40)) / 8, s + 5 + float(rng.integers(0, 16)) / 8, int(rng.integers(1, 30))))
    df = both.createDataFrame(jobs, "id string, submit_h double, start_h double, end_h double, nodes int")
    got = {r.id: r.most_free for r in N.free_while_waiting(df, 100.0).collect()}
    busy = lambda t: sum(n for _, _, s, e, n in jobs if s is not None and s <= t and (e is None or t < e))
    instants = sorted({x for j in jobs for x in j[2:4] if x is not None})
    for i, s, b, _, _ in jobs:
        want = max(100 - busy(t) for t in [s, *[x for x in instants if s < x < b]]) if b is not None and s < b else None
        assert got[i] == want, (i, got[i], want)
    alone = both.createDataFrame(jobs[:5], "id string, submit_h double, start_h double, end_h double, nodes int").withColumn("queue", F.lit("q"))
    share = {r.queue: (r.n, r.n_avoidable) for r in N.waited_despite_free(alone, 100.0, 100.0).collect()}
    assert share == {"q": (5, 0)}  # d needs all nodes; 10.1 to 30 has 40 free, and the minute from 10 has 60
    less = alone.withColumn("nodes", F.when(F.col("id") == "d", 59).otherwise(F.col("nodes")))
    assert N.waited_despite_free(less, 100.0, 100.0).first().n_avoidable == 1


def test_fits_of_a_popular_size_are_cut_by_length(spark):
    prof = [(float(t), float(1 + (t * 7919) % 97)) for t in range(600)]
    reqs = spark.range(3000).select(F.lit(40).alias("nodes"), (F.col("id") / 500 + 0.5).alias("walltime_h"))
    spark.conf.set("nodehours.blockRows", "200")
    try:
        got = {r.walltime_h: r.fit_h for r in L.earliest_fit(reqs, spark.createDataFrame(prof, "t_h double, free double")).collect()}
    finally:
        spark.conf.unset("nodehours.blockRows")
    runs, k = [], 0
    while k < 600:
        if prof[k][1] >= 40:
            e = next((i for i in range(k, 600) if prof[i][1] < 40), 600)
            runs.append((float(k), float("inf") if e == 600 else float(e - k)))
            k = e
        k += 1
    assert len(got) == 3000
    for w, t in got.items():
        assert t == next((s for s, n in runs if n >= w - 1e-9 and s < 599), None), w


def test_carried_rows_stay_where_keys_are(spark):
    spark.conf.set("nodehours.blockRows", "50")
    try:
        left = spark.range(2000).select((F.col("id") % 400).alias("k"), (F.col("id") * 1.0).alias("t"))
        right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 4.0).alias("t"), F.col("id").alias("v"))
        got = B.asof(left, right, "t", ["v"], keys=["k"]).collect()
        cuts = B.cut_points(left.select("t").unionAll(right.select("t")), "t")
        rows = B._carry(B.with_block(left.withColumn("_t", F.col("t")), "_t", cuts),
                        B.with_block(right.withColumn("_t", F.col("t")), "_t", cuts).withColumn("_r", F.struct("t", "v")), ["k"], len(cuts.points)).count()
    finally:
        spark.conf.unset("nodehours.blockRows")
    assert len(got) == 2000 and all(r.v == (r.k if r.t >= r.k * 4.0 else None) for r in got)
    assert rows <= 2400 < 400 * (len(cuts.points) + 1)


def test_windows_of_availability_move_once(spark):
    w = spark.range(1000).select((F.col("id") % 300 * 1.0).alias("start_h"), (F.col("id") % 300 + 5.0).alias("end_h"), F.lit(2).alias("nodes"))
    a = T.availability(spark.createDataFrame([(0.0, 500.0), (100.0, 700.0), (100.0, 600.0)], "t_h double, up double"), w, 650)
    plan = a._jdf.queryExecution().executedPlan().toString()
    # the windows were moved when they were netted; what is left orders the netted events, and finds the first value
    assert "Exchange hashpartitioning" not in plan and plan.count("Exchange SinglePartition") <= 2
    got = {r.t_h: (r.up, r.available) for r in a.collect()}
    for t, (up, free) in got.items():
        held = sum(2 for i in range(1000) if i % 300 <= t < i % 300 + 5)
        assert up == (500.0 if t < 100 else 700.0) and free == max(0.0, min(up, 650.0, 650.0 - held))


def test_codes_and_bands_of_any_number(spark):
    spark.conf.set("nodehours.blockRows", "20000")
    try:
        df = spark.range(150_000).select(F.format_string("u%07d", (F.col("id") * 7919) % 150_000).alias("user"), F.col("id").alias("lo"), (F.col("id") + F.when(F.col("id") == 70_000, 1).otherwise(0)).alias("hi"))
        coded = C.dense_codes(df, ["user"])
        assert coded.where(F.col("user_code") != F.substring("user", 2, 7).cast("int")).count() == 0 and coded.count() == 150_000
        gaps = C.band_gaps(df, "lo", "hi", first=0).collect()
    finally:
        spark.conf.unset("nodehours.blockRows")
    assert [tuple(r) for r in gaps] == [(70_001, 70_001, 70_001, "overlap")]


def test_series_on_a_grid_that_does_not_meet_the_end(spark):
    from nodehours.blocks import n_covering
    assert [n_covering(0.0, t1, 0.25) for t1 in (1.0, 1.1, 0.0, 0.2)] == [5, 6, 1, 2]
    snaps = spark.createDataFrame([(0.0, 90.0), (1.2, 50.0)], "t_h double, up double")
    none = spark.createDataFrame([], "start_h double, end_h double, nodes int")
    got = {r.t_h: r.usable for r in T.usable_series(snaps, none, none, 1.1, 0.3).collect()}
    assert sorted(got) == [0.0, 0.25, 0.5, 0.75, 1.0, 1.25] and got[1.25] == 50.0
    late = T.usable_series(snaps.where("t_h > 1"), none, none, 1.1, 0.3, otherwise=7.0).collect()
    assert [r.t_h for r in late] == [0.0, 0.25, 0.5, 0.75, 1.0, 1.25] and {r.usable for r in late} == {7.0}


def test_a_million_instants(spark):
    jobs = spark.createDataFrame([(i, i * 7.3, None if i % 9 == 0 else i * 7.3 + (i % 5) * 3.1, 2, 1.5, "p") for i in range(40)],
                                 "job_id long, submit_h double, start_h double, nodes int, runtime_h double, project string")
    ts = spark.range(1_000_000).select((F.col("id") / 1000.0).alias("t_h"))
    n = {r.job_id: r.n for r in P.pending_at(jobs, ts).groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = np.arange(1_000_000) / 1000.0
    for r in jobs.collect():
        upto = 1_000_000 if r.start_h is None else np.searchsorted(at, r.start_h)
        assert n.get(r.job_id, 0) == max(0, upto - np.searchsorted(at, r.submit_h)), r
    d = P.delivered_at(jobs, ["project"], ts)
    started = [r.start_h for r in jobs.collect() if r.start_h is not None]
    assert d.count() == 1_000_000
    for r in d.where("t_h IN (0.5, 100.25, 280.0, 999.999)").collect():
        assert r.delivered_nh == 3.0 * sum(s <= r.t_h for s in started)


def test_upsert_parts_touches_only_hit_folders(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("at"), (F.col("id") % 7).alias("more"))
    tables.write_parts(rows, path, ["k"], ["at"], 16)
    files = lambda: {f for f in (tmp_path / "keyed").rglob("*.parquet")}
    before = files()
    assert len({f.parent for f in before}) == 16
    # one key written three times, one new key and one null key, without the column `more`
    new = spark.createDataFrame([(5, "a", 2), (5, "b", 3), (5, "c", 3), (90_000, "n", 1), (None, "z", 1)], "k long, v string, at int")
    hit = {r[0] for r in new.select(tables.part_of(["k"], 16)).distinct().collect()}
    assert tables.upsert_parts(new, path, ["k"], ["at"], 16) == len(hit) < 16
    changed = {f.parent.name for f in before ^ files()}
    assert changed == {f"_part={p}" for p in hit}
    got = {r.k: (r.v, r.at, r.more) for r in tables.read_parts(spark, path).collect()}
    assert len(got) == 2002 and got[5] == ("c", 3, None) and got[90_000] == ("n", 1, None) and got[None] == ("z", 1, None) and got[6] == ("old", 1, 6)
    # a null key is one key; writing the same again changes nothing but files
    tables.upsert_parts(new, path, ["k"], ["at"], 16)
    assert {r.k: (r.v, r.at, r.more) for r in tables.read_parts(spark, path).collect()} == got
    assert tables.upsert_parts(new.limit(0), path, ["k"], ["at"], 16) == 0
    with pytest.raises(ValueError):
        tables.upsert_parts(new.withColumn("other", F.lit(1)), path, ["k"], ["at"], 16)


def test_last_writes_is_cut_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"), F.lit("x").alias("v"))
    plan = tables.last_writes(rows, ["k"], ["at"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("WindowGroupLimit") == 2


def test_what_if_over_a_large_design(spark):
    jobs = spark.createDataFrame([(float(i), "a" if i % 3 else "b") for i in range(12)], "size double, queue string")
    points = spark.range(50_000).select((F.col("id") / 10).alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    points = points.unionByName(points.limit(10)).unionByName(spark.createDataFrame([(None, 1.0)], "x double, y double"))
    out = E.what_if(jobs, points, F.col("x") * F.col("size") - F.col("y"), ["queue"], at_once=20_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.x, r.y, r.queue): (r.n, r["mean"], r["max"]) for r in out.collect()}
    assert len(got) == 2 * 50_001 and got[None, 1.0, "a"] == (0, None, None)
    sizes = {q: [float(i) for i in range(12) if ("a" if i % 3 else "b") == q] for q in "ab"}
    for i in range(0, 50_000, 487):
        for q, s in sizes.items():
            values = [i / 10 * v - i % 5 for v in s]
            n, mean, most = got[i / 10, float(i % 5), q]
            assert n == len(s) and mean == pytest.approx(sum(values) / len(s)) and most == pytest.approx(max(values))


def test_split_columns_by_name(spark):
    df = spark.createDataFrame([], "config_hash string, seed int, status string, runtime_s double, note string, policy string, m_factor double, n_jobs long, "
                                   "wait_p95 double, alloc_util double, prog_a_delivered decimal(10,2), wait_label string, x_burn float")
    params, metrics = E.split_columns(df)
    assert params == ["policy", "m_factor"]
    assert metrics == ["n_jobs", "wait_p95", "alloc_util", "prog_a_delivered", "x_burn"]


def test_pending_counts_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "ARRAY_ROWS", 4)
    monkeypatch.setattr("nodehours.blocks.ARRAY_ROWS", 4)
    rows = [(i, float(i % 11), None if i % 7 == 0 else i % 11 + i % 9 / 2) for i in range(200)] + [(200, None, 3.0), (201, 5.0, 4.0)]
    jobs = spark.createDataFrame(rows, "job_id int, submit_h double, start_h double")
    ts = [x / 4 for x in range(-3, 40)] + [100.0, 3.0]
    table = spark.createDataFrame([(t,) for t in ts] + [(None,)], "t_h double")
    want = {i: n for i, a, b in rows if a is not None and (n := sum(a <= t and (b is None or t < b) for t in set(ts)))}
    for instants in (ts, table):
        got = P.count_pending_at(jobs, instants)
        assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r.job_id: r.n_instants for r in got.collect()} == want


def test_maxima_of_waits_take_no_slice_for_each_step(spark, monkeypatch):
    from nodehours.operators import findings
    made = []
    stored = findings.stored
    monkeypatch.setattr(findings, "stored", lambda df: made.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df))
    rows = [(i, i * 0.37, i * 0.37 + (i * 7) % 11, i * 0.37 + (i * 7) % 11 + 1 + i % 5, 1 + i * 13 % 40) for i in range(300)]
    jobs = spark.createDataFrame(rows, "job_id int, submit_h double, start_h double, end_h double, nodes int")
    got = {r.job_id: r.most_free for r in findings.free_while_waiting(jobs, 500.0).collect()}
    assert not any("slice(vs" in p for p in made)
    busy = lambda t: sum(n for _, _, s, e, n in rows if s <= t < e)
    at = sorted({x for r in rows for x in r[2:4]})
    for i, a, b, _, _ in rows:
        assert got[i] == (500.0 - min(busy(t) for t in [a, *(x for x in at if a < x < b)]) if a < b else None)


def test_rows_of_all_pools_are_numbered_through(spark):
    from nodehours.operators.sampling import cell_pools

    profile = spark.createDataFrame([(i, 1, 1.0, 0.5, "AB"[i % 2] if i else None, i % 3, "small") for i in range(20)],
                                    "job_id long, nodes int, walltime_h double, rt_ratio double, program string, alloc_off int, size_tier string")
    rows = cell_pools(profile).collect()
    assert sorted(r._row for r in rows) == list(range(1, 41))  # two pools hold each row
    first = {}
    for r in rows:
        first.setdefault((r._p, r._o, r._t), set()).add(r._row - r._idx)
    assert all(len(x) == 1 for x in first.values())
