"""Experiment grids and the reduction of Monte Carlo results."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodehours.blocks import dim_rows, join_on, numbered, stored, uniform
from nodehours.functions import clean as C
from nodehours.operators.quantiles import summarize

PACK = 1_000  # design points of one array, about
AT_ONCE = 200_000  # design points broadcast to a pass over the jobs
META = ("config_hash", "seed", "status", "runtime_s", "note")


# --------------------------------------------------------------------------
# designs
# --------------------------------------------------------------------------


def levels(df: DataFrame, cols: Sequence[str], limit: int = 1000) -> dict[str, list]:
    """Distinct values per column, for use as design levels; their number is checked."""
    return {c: sorted(r[0] for r in dim_rows(df.where(F.col(c).isNotNull()).select(c).distinct(), [c], limit)) for c in cols}


def full_factorial(spark: SparkSession, params: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the listed values, by generators rather than joins."""
    out = spark.range(1).drop("id")
    for name, values in params.items():
        vals = list(values) if isinstance(values, (list, tuple)) else [values]
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in vals])).alias(name))
    return out


def latin_hypercube(spark: SparkSession, ranges: Mapping[str, tuple[float, float]], choices: Mapping[str, Sequence],
                    n: int, seed: int) -> DataFrame:
    """n points: one per stratum in every range dimension, uniform choices for list dimensions."""
    dims = F.array(*[F.struct(F.lit(k).alias("dim"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
                     for k, (lo, hi) in ranges.items()])
    rows = spark.range(n).withColumnRenamed("id", "i").select("i", F.explode(dims).alias("d")).select("i", "d.*")
    rows = rows.withColumn("_u", uniform("dim", "i", seed=f"perm{seed}"))
    rows = numbered(rows, ["dim"], "_u", ["i"], "_rn")
    at = (F.col("_rn") - 1 + uniform("dim", "i", seed=f"jitter{seed}")) / n
    rows = rows.withColumn("value", F.col("lo") + at * (F.col("hi") - F.col("lo")))
    out = rows.groupBy("i").agg(*[F.max(F.when(F.col("dim") == k, F.col("value"))).alias(k) for k in ranges])
    for name, opts in choices.items():
        arr = F.array(*[F.lit(o) for o in opts])
        u = uniform(F.lit(name), "i", seed=f"choice{seed}")
        out = out.withColumn(name, F.get(arr, F.floor(u * len(opts)).cast("int")))
    return out


def tasks(points: DataFrame, n_seeds: int, base_seed: int = 0, labels: Sequence[str] | None = None) -> DataFrame:
    """Each point with its configuration hash, once per seed."""
    cols = list(labels or points.columns)
    seeds = F.explode(F.sequence(F.lit(base_seed), F.lit(base_seed + n_seeds - 1))).alias("seed")
    return points.withColumn("config_hash", C.config_hash(cols)).select("config_hash", *points.columns, seeds)


def what_if(jobs: DataFrame, points: DataFrame, formula: Column, keys: Sequence[str] = (), at_once: int = AT_ONCE) -> DataFrame:
    """Mean and maximum of a formula over all jobs at every design point.

    The design is a written table of any length, packed into arrays of about PACK points by hash. Each job meets the packs by
    their number and is expanded where it is read, so only sums per point are shuffled. At most about at_once points
    are broadcast at a time; a longer design takes more passes over the jobs. A point that repeats counts once.
    """
    cols = points.columns
    design = stored(points.distinct())
    n = design.count()
    passes = max(1, -(-n // at_once))
    packs = max(1, -(-n // (passes * PACK)))
    pack = F.pmod(F.xxhash64(*cols), F.lit(passes * packs)).cast("int").alias("_pack")
    packed = stored(design.groupBy(pack).agg(F.collect_list(F.struct(*cols)).alias("_points")))
    out = None
    for k in range(passes):
        first, last = k * packs, (k + 1) * packs - 1
        some = F.broadcast(packed.where(F.col("_pack").between(first, last)))
        rows = jobs.withColumn("_pack", F.explode(F.sequence(F.lit(first), F.lit(last)))).join(some, "_pack").drop("_pack")
        rows = rows.withColumn("_p", F.explode("_points")).drop("_points")
        rows = rows.withColumns({c: F.col(f"_p.{c}") for c in cols}).withColumn("_x", formula)
        part = rows.groupBy(*cols, *keys).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.max("_x").alias("max"))
        out = part if out is None else out.unionByName(part)
    return out


# --------------------------------------------------------------------------
# reductions
# --------------------------------------------------------------------------


def is_metric(name: str) -> bool:
    """Result columns that are metrics by name; other non-meta columns are swept parameters."""
    # fixed values: metric names and name patterns of the result table
    exact = {"alloc_util", "node_hours_delivered", "throughput_jobs_per_day"}
    prefix = ("n_", "wait_", "big_", "small_", "avg_", "q_", "prog_")
    suffix = ("_delivered", "_delivered_nh", "_wait_p95", "_burn", "_thresh_nodes")
    return name in exact or name.startswith(prefix) or name.endswith(suffix)


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(parameters, numeric metrics) of a result table."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    metrics = [c for c, t in df.dtypes if is_metric(c) and c not in META and (t in numeric or t.startswith("decimal"))]
    params = [c for c in df.columns if c not in META and not is_metric(c)]
    return params, metrics


MC_QUANTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
MC_STATS = ["mean", "ci95", "std", "cv", *MC_QUANTILES]


def mc_summary(results: DataFrame, params: Sequence[str] | None = None, metrics: Sequence[str] | None = None) -> DataFrame:
    """Per configuration and metric: n, mean, 95 % interval, sd, CV and percentiles over seeds (long form).

    Only successful runs count and non-finite values are dropped.  With one
    value sd and interval are 0; CV is NULL at mean 0.
    """
    if params is None or metrics is None:
        p, m = split_columns(results)
        params, metrics = p if params is None else params, m if metrics is None else metrics
    params, metrics = list(params), list(metrics)
    # labels, moments and quantiles read the runs, which may cost much to compute
    ok = stored(results.where(F.col("status") == "OK").select("config_hash", "seed", *params, *metrics))
    labels = ok.groupBy("config_hash").agg(F.count(F.lit(1)).alias("n_seeds"),
                                           *[F.min_by(c, "seed").alias(c) for c in params])
    long = ok.select("config_hash", *[F.col(c).cast("double").alias(c) for c in metrics]).unpivot(
        "config_hash", metrics, "metric", "value")
    finite = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))
    s = summarize(finite, ["config_hash", "metric"], {"n": F.count("value"), "mean": F.avg("value"),
                                                      "std": F.coalesce(F.stddev_samp("value"), F.lit(0.0))},
                  [(F.col("value"), MC_QUANTILES)])
    s = s.withColumn("ci95", 1.96 * F.col("std") / F.sqrt("n")).withColumn(
        "cv", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")))
    return join_on(s, labels, ["config_hash"]).select("config_hash", "n_seeds", *params, "metric", "n", *MC_STATS)


def mc_wide(long: DataFrame, params: Sequence[str], metrics: Sequence[str], digits: int = 4) -> DataFrame:
    """One row per configuration with ``<metric>__<stat>`` columns."""
    cols = [F.round(F.max(F.when(F.col("metric") == m, F.col(s))), digits).alias(f"{m}__{s}") for m in metrics for s in MC_STATS]
    return long.groupBy("config_hash", "n_seeds", *params).agg(*cols)


def seed_agg(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample sd over seeds per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_seeds"), *[
        f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def main_effect(stats: DataFrame, param: str, metric: str) -> DataFrame:
    """Mean objective and mean interval per value of one parameter."""
    return (stats.where(F.col("metric") == metric).groupBy(param)
            .agg(F.count(F.lit(1)).alias("n_configs"), F.avg("mean").alias("mean"), F.avg("ci95").alias("ci95")))


def sensitivity(stats: DataFrame, params: Sequence[str], metric: str | None = None) -> DataFrame:
    """Largest minus smallest group mean per parameter with at least two values, per metric, ranked."""
    rows = stats if metric is None else stats.where(F.col("metric") == metric)
    long = rows.select("metric", "mean", *[F.col(p).cast("string").alias(p) for p in params]).unpivot(
        ["metric", "mean"], list(params), "param", "level")
    groups = long.where(F.col("level").isNotNull()).groupBy("metric", "param", "level").agg(F.avg("mean").alias("m"))
    out = (groups.groupBy("metric", "param").agg(F.count(F.lit(1)).alias("n_levels"), (F.max("m") - F.min("m")).alias("effect"))
           .where(F.col("n_levels") >= 2))
    # one row per metric and parameter
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.col("effect").desc(), "param")))


def cross_series(results: DataFrame, param: str, prefix: str, suffix: str) -> DataFrame:
    """Mean of every ``<prefix><name><suffix>`` metric against one swept parameter, long."""
    cols = [c for c in results.columns if c.startswith(prefix) and c.endswith(suffix) and len(c) > len(prefix) + len(suffix)]
    long = results.where(F.col("status") == "OK").select(param, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        param, cols, "metric", "value")
    name = F.regexp_extract("metric", "^" + re.escape(prefix) + "(.*)" + re.escape(suffix) + "$", 1)
    return long.groupBy(param, name.alias("name")).agg(F.avg("value").alias("mean"))


def rollup_by(results: DataFrame, derived: Column, name: str, metrics: Sequence[str]) -> DataFrame:
    """Mean outcome per derived parameter, over successful runs."""
    ok = results.where(F.col("status") == "OK")
    return ok.groupBy(derived.alias(name)).agg(*[F.avg(m).alias(m) for m in metrics])


def top_configs(stats: DataFrame, metric: str, n: int, ascending: bool = False) -> DataFrame:
    """Best (or worst) n configurations by the mean of a metric."""
    by = F.col("mean").asc() if ascending else F.col("mean").desc()
    return stats.where(F.col("metric") == metric).orderBy(by, "config_hash").limit(n)


def refine(results: DataFrame, objective: str, k: int, n_seeds: int, params: Sequence[str], maximize: bool = True,
           base_seed: int = 0) -> DataFrame:
    """Top-k configurations by mean objective with their label values, replicated over new seeds."""
    ok = results.where(F.col("status") == "OK")
    per = ok.groupBy("config_hash").agg(F.avg(objective).alias("objective"), *[F.min_by(p, "seed").alias(p) for p in params])
    by = F.col("objective").desc() if maximize else F.col("objective").asc()
    top = per.orderBy(by, "config_hash").limit(k)
    seeds = F.explode(F.sequence(F.lit(base_seed), F.lit(base_seed + n_seeds - 1))).alias("seed")
    return top.select("*", seeds)
