"""Block primitives against brute force, including hot keys and hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nodehours import blocks as B
from nodehours.operators import quantiles as Q


@pytest.fixture(params=["150", "1000000"], ids=["blocks", "one block"])
def spark(spark, request):
    """Every test runs over many blocks and over a single one."""
    spark.conf.set("nodehours.blockRows", request.param)
    yield spark
    spark.conf.unset("nodehours.blockRows")


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(7)
    n = 4000
    return pd.DataFrame({
        "id": np.arange(n),
        "g": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n)),
        "t": np.where(rng.random(n) < 0.35, 5.0, np.round(rng.random(n) * 100, 2)),
        "v": np.where(rng.random(n) < 0.35, 0.0, np.round(rng.exponential(3, n), 3)),
        "u": np.round(rng.normal(4, 2, n), 2)})


def test_cut_points_see_a_hot_value(spark, sample):
    cuts = B.cut_points(spark.createDataFrame(sample), "t")
    if B.block_rows(spark) > len(sample):
        assert cuts == B.Cuts()
    else:
        assert max(cuts.heavy.values()) >= 8 and list(cuts.points) == sorted(set(cuts.points))


def test_more_blocks_than_one_pass_can_cut(spark, sample, monkeypatch):
    monkeypatch.setattr(B, "COARSE_CUTS", 4)
    df = spark.createDataFrame(sample)
    blocks = B.with_block(df, "u", B.cut_points(df, "u")).groupBy(B.BLK).count().toPandas()["count"]
    assert len(blocks) == 1 if B.block_rows(spark) > len(sample) else (len(blocks) >= 20 and blocks.max() < 600)
    got = B.numbered(df, [], "u", ["id"]).toPandas().sort_values(["u", "id"])
    assert (got.rn.to_numpy() == np.arange(1, len(sample) + 1)).all()


@pytest.mark.parametrize("ascending", [True, False])
def test_numbered_places_nulls_and_nan(spark, sample, ascending):
    rows = [(i, None if i % 5 == 0 else float("nan") if i % 7 == 0 else float(v)) for i, v in zip(sample.id, sample.u)]
    df = spark.createDataFrame([(int(i), v) for i, v in rows], "id long, v double")
    by = F.col("v").asc() if ascending else F.col("v").desc()
    want = {r.id: k for k, r in enumerate(df.orderBy(by, "id").collect(), 1)}
    assert {r.id: r.rn for r in B.numbered(df, [], "v", ["id"], ascending=ascending).collect()} == want


def test_numbered_orders_texts(spark, sample):
    ids = [f"job.{i * 7919 % 4001}é" for i in sample.id] + ["", "job", "job.zz", "job.1"]
    df = spark.createDataFrame([(x, k) for k, x in enumerate(ids)] + [(None, -1)], "id string, k long")
    want = [r.k for r in df.orderBy("id", "k").collect()]
    assert [r.k for r in B.numbered(df, [], "id", ["k"]).orderBy("rn").collect()] == want
    same = df.withColumn("v", F.lit(1.0))  # one value fills all blocks: the text tie cuts it
    assert [r.k for r in B.numbered(same, [], "v", ["id", "k"]).orderBy("rn").collect()] == want


def test_asof_without_a_position_finds_nothing(spark):
    df = spark.createDataFrame([(None,), (0.5,), (2.0,)], "t double")
    series = spark.createDataFrame([(1.0, 7)], "t double, lvl int")
    assert {r.t: r.lvl for r in B.asof(df, series, "t", ["lvl"]).collect()} == {None: None, 0.5: None, 2.0: 7}


def test_running_matches_pandas(spark, sample):
    per = sample.groupby(["g", "t"], as_index=False).v.sum()
    out = B.running(spark.createDataFrame(per), ["g"], "t", {
        "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "z": ("last", "v")}).toPandas()
    out = out.sort_values(["g", "t"]).reset_index(drop=True)
    exp = per.sort_values(["g", "t"]).reset_index(drop=True)
    g = exp.groupby("g").v
    assert np.allclose(out.s, g.cumsum()) and np.allclose(out.lo, g.cummin()) and np.allclose(out.hi, g.cummax())
    assert np.allclose(out.z, exp.v)


def test_numbered_is_dense_and_ordered(spark, sample):
    out = B.numbered(spark.createDataFrame(sample), ["g"], "v", [F.col("id")], ascending=False).toPandas()
    exp = sample.sort_values(["g", "v", "id"], ascending=[True, False, True])
    exp["rn"] = exp.groupby("g").cumcount() + 1
    m = out.merge(exp, on="id")
    assert (m.rn_x == m.rn_y).all() and len(m) == len(sample)


def test_numbered_with_a_hot_value_and_ties(spark, sample):
    out = B.numbered(spark.createDataFrame(sample), [], "t", ["id"]).toPandas()
    exp = sample.sort_values(["t", "id"]).reset_index(drop=True)
    exp["rn"] = exp.index + 1
    m = out.merge(exp, on="id")
    assert (m.rn_x == m.rn_y).all()


@pytest.mark.parametrize("step", [1, -1])
def test_following(spark, sample, step):
    per = sample.drop_duplicates(["g", "t"])
    out = B.following(spark.createDataFrame(per), ["g"], "t", {"nxt": "v"}, step).toPandas().sort_values(["g", "t"])
    exp = per.sort_values(["g", "t"]).groupby("g").v.shift(-step)
    assert np.allclose(out.nxt.fillna(-1), exp.fillna(-1))


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_with_hot_instant(spark, sample, direction):
    series = pd.DataFrame({"t": [1.0, 5.0, 5.5, 40.0, 80.0], "lvl": [1, 2, 3, 4, 5]})
    out = B.asof(spark.createDataFrame(sample), spark.createDataFrame(series), "t", ["lvl"],
                 direction=direction, at="hit").toPandas().sort_values("id")
    exp = pd.merge_asof(sample.sort_values("t"), series.assign(hit=series.t), on="t", direction=direction)
    exp = exp.sort_values("id")
    assert len(out) == len(sample)
    assert np.array_equal(out.lvl.fillna(-1).to_numpy(float), exp.lvl.fillna(-1).to_numpy(float))
    assert np.allclose(out.hit.fillna(-1), exp.hit.fillna(-1))


def test_bin_sums_against_overlap(spark):
    rng = np.random.default_rng(3)
    s = rng.random(500) * 30 - 3
    iv = pd.DataFrame({"s": s, "e": s + rng.exponential(4, 500), "n": rng.integers(1, 50, 500)})
    t0, t1, dt = 0.0, 24.25, 0.5
    out = B.bin_sums(spark.createDataFrame(iv), "s", "e", "n", t0, t1, dt).toPandas().sort_values("bin")
    edges = np.append(np.arange(t0, t1, dt), t1)
    exp = [(iv.n * np.clip(np.minimum(iv.e, b) - np.maximum(iv.s, a), 0, None)).sum() for a, b in zip(edges, edges[1:])]
    assert np.allclose(out.total, exp)
    lvl = B.level_on_grid(spark.createDataFrame(iv), "s", "e", "n", t0, 24.0, dt).toPandas().sort_values("bin")
    exp = [iv.n[(iv.s <= t) & (t < iv.e)].sum() for t in lvl.t_h]
    assert np.allclose(lvl.level, exp)


def test_grid_levels_keyed_with_gaps_and_late_keys(spark):
    rows = [("a", 2.2, 3.7, 2), ("a", 6.0, 99.0, 1), ("b", 0.0, 0.5, 4), ("b", 7.9, 8.0, 8), ("c", -5.0, 20.0, 3), ("d", 50.0, 60.0, 9)]
    df = spark.createDataFrame(rows, "k string, s double, e double, n int")
    got = {(r.k, r.t_h): r.level for r in B.level_on_grid(df, "s", "e", "n", 0.0, 8.0, 1.0, ["k"]).collect()}
    exp = {(k, float(t)): float(sum(n for q, s, e, n in rows if q == k and s <= t < e)) for k in "abcd" for t in range(9)}
    assert got == exp
    tot = {(r.k, r.t_h): r.total for r in B.bin_sums(df, "s", "e", "n", 0.0, 7.5, 2.0, ["k"]).collect()}
    exp = {(k, t): sum(n * max(0.0, min(e, t + 2, 7.5) - max(s, t)) for q, s, e, n in rows if q == k) for k in "abc" for t in (0.0, 2.0, 4.0, 6.0)}
    assert tot == pytest.approx(exp)


def test_quantiles(spark, sample):
    probs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    out = Q.quantiles(spark.createDataFrame(sample), ["g"], "v", probs).toPandas().set_index("g")
    for g, part in sample.groupby("g"):
        for c, p in probs.items():
            assert out.loc[g, c] == pytest.approx(np.quantile(part.v, p))


def test_ks_spearman_ecdf(spark, sample):
    df = spark.createDataFrame(sample)
    ks = Q.ks_distance(df, "v", "u", ["g"]).toPandas().set_index("g").ks
    rho = Q.spearman(df, "v", "u", ["g"]).toPandas().set_index("g").spearman
    for g, p in sample.groupby("g"):
        grid = np.concatenate([p.v, p.u])
        fa = np.searchsorted(np.sort(p.v), grid, "right") / len(p)
        fb = np.searchsorted(np.sort(p.u), grid, "right") / len(p)
        assert ks[g] == pytest.approx(np.abs(fa - fb).max())
        assert rho[g] == pytest.approx(np.corrcoef(p.v.rank(), p.u.rank())[0, 1])
    cdf = Q.ecdf(df, "v").toPandas().sort_values("v")
    assert cdf.cdf.iloc[-1] == pytest.approx(1) and cdf.cdf.is_monotonic_increasing


def test_ks_half_shift(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") + 50.0).alias("b"))
    assert Q.ks_distance(df, "a", "b").first().ks == pytest.approx(0.5, abs=0.02)
    assert Q.ks_distance(df.withColumn("b", F.col("a")), "a", "b").first().ks == 0.0


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_partition_count_does_not_matter(spark, sample, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = Q.quantiles(spark.createDataFrame(sample).repartition(parts), [], "v", {"p": 0.9})
        assert out.first().p == pytest.approx(np.quantile(sample.v, 0.9))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_per_block_tables_beyond_the_count_are_not_broadcast(spark):
    # few bytes in a file, many rows in the driver: the file's size must not decide
    many = spark.range(30_000).select((F.col("id") % 3000).cast("string").alias("g"), F.col("id").cast("double").alias("t"), F.lit(1).alias("d"))
    run = B.running(many, ["g"], "t", {"level": ("sum", "d")}, cuts=B.Cuts((10_000.0, 20_000.0, 25_000.0, 28_000.0)))
    assert "Broadcast" not in run._jdf.queryExecution().executedPlan().toString()
    assert run.groupBy("g").agg(F.max("level").alias("n")).where("n <> 10").count() == 0
