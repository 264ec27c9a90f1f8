"""Wait and utilisation statistics, distribution comparison, breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodehours.blocks import Cuts, cut_points, fill_grid, join_on, level_on_grid, stored
from nodehours.functions import clean as C
from nodehours.functions.constants import PRODUCTION_NODES, TOTAL_NODES, WAIT_QUANTILES, YEAR_H
from nodehours.operators.quantiles import ks_distance, spearman, summarize

MINUTE = 1.0 / 60.0


def _named(prefix: str, probs: dict[str, float]) -> dict[str, float]:
    return {f"{prefix}_{k}_h": p for k, p in probs.items()}


def wait_summary(df: DataFrame, keys: Sequence[str] = (), wait: str = "wait_h", lower: str | None = "wait_lb_h") -> DataFrame:
    """Waits of started jobs, and with censored jobs at their lower bound; NULL (never 0) when nothing started."""
    aggs = {"n_started": F.count(wait), "n_censored": F.lit(0).cast("long"), "started_mean_h": F.avg(wait)}
    quants = [(F.col(wait), _named("started", WAIT_QUANTILES))]
    if lower:
        aggs["n_censored"] = F.count_if(F.col(wait).isNull() & F.col(lower).isNotNull())
        quants.append((F.coalesce(F.col(wait), F.col(lower)), _named("lb", WAIT_QUANTILES)))
    return summarize(df, keys, aggs, quants)


def queue_percentiles(df: DataFrame, key: str = "size_tier", wait: str = "wait_h") -> DataFrame:
    """Wait percentiles of started jobs per queue; queues without a start give no row."""
    q = {"wait_p50_h": 0.5, "wait_p90_h": 0.9, "wait_p95_h": 0.95, "wait_p99_h": 0.99}
    return summarize(df.where(F.col(wait).isNotNull()), [key],
                     {"n": F.count(F.lit(1)), "wait_max_h": F.max(wait)}, [(F.col(wait), q)])


def compare(df: DataFrame, obs: str, other: str, keys: Sequence[str] = ()) -> DataFrame:
    """Paired comparison of two wait columns per group; pairs with a NULL are dropped.

    The narrow pairs are stored once, because every statistic reads them.
    """
    pairs = df.select(*keys, F.col(obs).cast("double").alias("_o"), F.col(other).cast("double").alias("_s"))
    return _compare(stored(pairs.where(F.col("_o").isNotNull() & F.col("_s").isNotNull())), list(keys))


def _compare(pairs: DataFrame, keys: list[str], cuts: Cuts | None = None, correlation: bool = True) -> DataFrame:
    probs = {"p50": 0.5, "p90": 0.9, "p95": 0.95}
    # a constant key keeps the three results on one equality join when there are no groups
    ks = keys or ["_all"]
    pairs = pairs if keys else pairs.withColumn("_all", F.lit(0))
    cuts = cut_points(pairs, "_o", "_s") if cuts is None else cuts
    out = summarize(pairs, ks, {"n": F.count(F.lit(1)), "obs_mean_h": F.avg("_o"), "sim_mean_h": F.avg("_s")},
                    [(F.col("_o"), _named("obs", probs)), (F.col("_s"), _named("sim", probs))], cuts)
    out = join_on(out, ks_distance(pairs, "_o", "_s", ks, cuts), ks, "left")
    if correlation:
        out = join_on(out, spearman(pairs, "_o", "_s", ks), ks, "left")

    def ratio(stat: str) -> Column:
        return F.log2((F.col(f"sim_{stat}_h") + MINUTE) / (F.col(f"obs_{stat}_h") + MINUTE))

    return out.withColumns({"log2_ratio_p50": ratio("p50"), "log2_ratio_mean": ratio("mean")}).drop("_all")


def compare_table(df: DataFrame, queues: Sequence[str], obs: str = "obs_wait_h", other: str = "sim_wait_lb_h",
                  keys: Sequence[str] = (), correlation: bool = True) -> DataFrame:
    """The comparison for ALL, every listed queue and ``other_queues``, with counts and node-hours.

    Each row counts under ALL and under its own label.  The needed columns are
    stored once, because every statistic reads them; the cut points of all are
    drawn from them, where a row stands once.  ``correlation`` False leaves out
    ``spearman``, which orders all pairs twice.
    """
    label = F.when(F.col("queue").isin(list(queues)), F.col("queue")).otherwise("other_queues")
    narrow = stored(df.select(*keys, label.alias("_label"), "sim_censored", (F.col("nodes") * F.col("runtime_h")).alias("_nh"),
                              F.col("obs_eligible_h").alias("_e"), F.col(obs).cast("double").alias("_o"),
                              F.col(other).cast("double").alias("_s")))
    rows = narrow.withColumn("group", F.explode(F.array(F.lit("ALL"), F.col("_label"))))
    keys = [*keys, "group"]
    side = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_jobs"), F.count_if("sim_censored").alias("n_sim_censored"),
        F.sum("_nh").alias("node_hours"), F.avg("_e").alias("obs_mean_eligible_h"))
    both = F.col("_o").isNotNull() & F.col("_s").isNotNull()
    pairs = rows.where(both).select(*keys, "_o", "_s")
    return join_on(side, _compare(pairs, keys, cut_points(narrow.where(both), "_o", "_s"), correlation), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def comparison_window(df: DataFrame, warmup_h: float, end_h: float, submit: str = "submit_h") -> DataFrame:
    """Arrivals submitted between warm-up and the end less cool-down, both included."""
    return df.where((F.col("role") == "arrival") & F.col(submit).between(warmup_h, end_h))


def fit_summary(table: DataFrame, queues: Sequence[str], keys: Sequence[str] = (), min_n: int = 30) -> DataFrame:
    """Overall figures and the fit score: mean over listed queues with enough jobs of KS + |log2 mean ratio|."""
    listed = F.col("group").isin(list(queues)) & (F.col("n") >= min_n)
    all_rows = F.col("group") == "ALL"
    return table.groupBy(*keys).agg(
        F.max(F.when(all_rows, F.col("n_jobs"))).alias("n_compared"),
        F.max(F.when(all_rows, F.col("n_sim_censored"))).alias("n_sim_censored"),
        F.max(F.when(all_rows, F.col("ks"))).alias("ks_all"),
        F.max(F.when(all_rows, F.col("log2_ratio_p50"))).alias("log2_ratio_p50_all"),
        F.avg(F.when(listed, F.col("ks") + F.abs("log2_ratio_mean"))).alias("fit_score"))


def compare_utilization(df: DataFrame, t0: float, t1: float, reportable: float = PRODUCTION_NODES, obs_start: str = "obs_start_h",
                        start: str = "start_h", end: str = "end_h", keys: Sequence[str] = ()) -> DataFrame:
    """Observed and second utilisation and node-hours over [t0, t1) of jobs with two starts; one aggregation.

    An observed job ends its runtime after the observed start.
    """
    def inside(s: Column, e: Column) -> Column:
        return F.coalesce(F.sum(F.col("nodes") * F.greatest(F.lit(0.0), F.least(e, F.lit(float(t1))) - F.greatest(s, F.lit(float(t0))))), F.lit(0.0))

    size = F.lit((t1 - t0) * float(reportable))
    out = df.groupBy(*keys).agg(inside(F.col(obs_start), F.col(obs_start) + F.col("runtime_h")).alias("obs_node_hours"),
                                inside(F.col(start), F.col(end)).alias("sim_node_hours"))
    return out.withColumns({"obs_util_reportable": F.col("obs_node_hours") / size, "sim_util_reportable": F.col("sim_node_hours") / size})


def rank_variants(summary: DataFrame, key: str = "variant") -> DataFrame:
    """Variants by fit score, best first."""
    return summary.withColumn("rank", F.row_number().over(Window.orderBy(F.col("fit_score").asc_nulls_last(), key)))


# --------------------------------------------------------------------------
# breakdowns
# --------------------------------------------------------------------------

P50_95 = {"wait_p50_h": 0.5, "wait_p95_h": 0.95}


def _window_nh(t1: float) -> Column:
    return F.col("nodes") * C.window_runtime("start_h", "end_h", t1)


def _credited() -> Column:
    """Node-hours credited in full at start."""
    return F.coalesce(F.sum(F.when(F.col("start_h").isNotNull(), F.col("nodes") * F.col("runtime_h"))), F.lit(0.0))


def decision_table(jobs: DataFrame, programs: DataFrame, t1: float, total_nodes: int = TOTAL_NODES) -> DataFrame:
    """Per program: jobs, unstarted, target and delivered share, budget burn, wait p50 / p95 / max."""
    per = summarize(jobs, ["program"], {
        "n_jobs": F.count(F.lit(1)), "unstarted": F.count_if(F.col("start_h").isNull()),
        "_nh": F.sum(_window_nh(t1)), "_credit": _credited(), "wait_max_h": F.max("wait_h")}, [(F.col("wait_h"), P50_95)])
    total = jobs.agg(F.sum(_window_nh(t1))).scalar()
    out = join_on(programs.select("program", "target_share"), per, ["program"], "left")
    budget = F.col("target_share") * F.lit(total_nodes * YEAR_H)
    return out.select("program", F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"), F.coalesce("unstarted", F.lit(0)).alias("unstarted"),
                      "target_share", F.try_divide(F.coalesce("_nh", F.lit(0.0)), total).alias("delivered_share"),
                      F.try_divide(F.coalesce("_credit", F.lit(0.0)), budget).alias("budget_burn"),
                      "wait_p50_h", "wait_p95_h", "wait_max_h")


def breakdowns(jobs: DataFrame, t1: float) -> DataFrame:
    """Per queue tier and per program, long: submitted, started, unstarted, node-hours, throughput, waits."""
    kinds = F.explode(F.array(F.struct(F.lit("q").alias("kind"), F.col("size_tier").alias("name")),
                              F.struct(F.lit("prog").alias("kind"), F.col("program").alias("name"))))
    rows = jobs.select("*", kinds.alias("_k")).select("*", "_k.kind", "_k.name")
    days = t1 / 24.0
    return summarize(rows, ["kind", "name"], {
        "submitted": F.count(F.lit(1)), "started": F.count("start_h"), "unstarted": F.count_if(F.col("start_h").isNull()),
        "delivered_nh": F.sum(_window_nh(t1)), "throughput_jpd": F.count_if(F.col("end_h") <= t1) / F.lit(days),
        "wait_max_h": F.max("wait_h")}, [(F.col("wait_h"), P50_95)])


def breakdowns_wide(long: DataFrame, names: Sequence[tuple[str, str]], metrics: Sequence[str]) -> DataFrame:
    """The breakdown as one row with a column per (kind, name, metric)."""
    return long.agg(*[F.max(F.when((F.col("kind") == k) & (F.col("name") == n), F.col(m))).alias(f"{k}_{n}_{m}")
                      for k, n in names for m in metrics])


def project_usage(jobs: DataFrame, awards: DataFrame) -> DataFrame:
    """Per awarded project: program, delivered node-hours (credited at start), award, percent used."""
    # hash-aggregate the jobs first; which program came first is decided on the small result
    per = jobs.groupBy("project", "program").agg(F.min("submit_h").alias("_first"), _credited().alias("_d"))
    per = per.groupBy("project").agg(F.min_by("program", F.struct("_first", "program")).alias("program"), F.sum("_d").alias("_d"))
    out = join_on(awards.select("project", "award_nh"), per, ["project"], "left")
    d = F.coalesce("_d", F.lit(0.0))
    return out.select("project", F.coalesce("program", F.lit("?")).alias("program"), d.alias("delivered_nh"), "award_nh",
                      F.when(F.col("award_nh") > 0, 100.0 * d / F.col("award_nh")).alias("pct_alloc_used"))


def run_summary(jobs: DataFrame, t1: float, production: int = PRODUCTION_NODES, sample_dt: float = 1.0,
                big_share: float = 0.2) -> DataFrame:
    """One row: counts, utilisation, node-hours, throughput, waits, large against small jobs."""
    big_nodes = round(big_share * production)
    big = F.col("nodes") >= big_nodes
    w = F.col("wait_h")
    util = level_on_grid(jobs, "start_h", "end_h", "nodes", 0.0, t1, sample_dt).agg(
        F.avg(F.col("level") / float(production) * 100)).scalar()
    out = summarize(jobs, [], {
        "n_jobs": F.count(F.lit(1)), "n_started": F.count("start_h"), "n_unstarted": F.count_if(F.col("start_h").isNull()),
        "n_completed": F.count_if(F.col("end_h") <= t1), "node_hours_delivered": F.sum(_window_nh(t1)),
        "throughput_jobs_per_day": F.count_if(F.col("end_h") <= t1) / F.lit(t1 / 24.0), "wait_max_h": F.max(w),
        "n_big_jobs": F.count_if(big), "n_big_unstarted": F.count_if(big & F.col("start_h").isNull()),
        "big_wait_max_h": F.max(F.when(big, w))},
        [(w, P50_95), (F.when(big, w), {f"big_{k}": p for k, p in P50_95.items()}),
         (F.when(~big, w), {f"small_{k}": p for k, p in P50_95.items()})])
    return out.withColumns({"avg_util_pct": util, "big_thresh_nodes": F.lit(big_nodes)})


def program_allocation(jobs: DataFrame, programs: DataFrame, t1: float, production: int = PRODUCTION_NODES,
                       total_nodes: int = TOTAL_NODES) -> DataFrame:
    """Delivered against allocated node-hours per program, also pro-rated to the window and as shares."""
    per = jobs.groupBy("program").agg(_credited().alias("_d"))
    total = join_on(per, programs.select("program"), ["program"], "left_semi").agg(F.sum("_d")).scalar()
    out = join_on(programs.select("program", "target_share"), per, ["program"], "left")
    d, b = F.coalesce("_d", F.lit(0.0)), F.col("target_share") * F.lit(total_nodes * YEAR_H)
    frac = min(1.0, t1 / YEAR_H)
    return out.select("program", d.alias("delivered_nh"), b.alias("allocated_nh"), "target_share",
                      F.try_divide(d, b).alias("usage_over_allocated"), F.try_divide(d, b * frac).alias("usage_over_prorated"),
                      (d / F.lit(production * YEAR_H)).alias("usage_over_annual_system"),
                      F.coalesce(F.try_divide(d, total), F.lit(0.0)).alias("delivered_share_of_used"))


def alloc_util(jobs: DataFrame, t1: float, keys: Sequence[str] = ()) -> DataFrame:
    """Delivered over requested node-hours of started jobs."""
    started = F.col("start_h").isNotNull()
    req = F.sum(F.when(started, F.col("nodes") * F.col("walltime_h")))
    return jobs.groupBy(*keys).agg(F.try_divide(F.sum(_window_nh(t1)), req).alias("alloc_util"))


def offered_load(jobs: DataFrame, t1: float, protected_tier: str, pool_nodes: int, big_min_nodes: int,
                 partition_nodes: int, total_nodes: int = TOTAL_NODES) -> DataFrame:
    """Offered against available node-hours: whole machine, protected tier in its pool, small jobs beside a partition."""
    nh = F.col("nodes") * F.col("runtime_h")
    scopes = [("machine", F.lit(True), total_nodes, 1.05),
              ("protected_pool", F.col("size_tier") == protected_tier, pool_nodes, 1.02),
              ("outside_partition", F.col("nodes") < big_min_nodes, total_nodes - partition_nodes, 1.02)]
    one = jobs.agg(*[F.coalesce(F.sum(F.when(c, nh)), F.lit(0.0)).alias(n) for n, c, _, _ in scopes])
    rows = one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("scope"), F.col(n).alias("offered_nh"), F.lit(float(cap * t1)).alias("capacity_nh"),
                 F.lit(lim).alias("limit")) for n, _, cap, lim in scopes])).alias("r")).select("r.*")
    factor = F.try_divide(F.col("offered_nh"), F.col("capacity_nh"))
    return rows.select("scope", "offered_nh", "capacity_nh", factor.alias("factor"),
                       F.coalesce(factor > F.col("limit"), F.lit(False)).alias("oversubscribed"))


def tier_mix(df: DataFrame, tiers: Sequence[str], key: str = "program", tier: str = "size_tier") -> DataFrame:
    """Row percentages of jobs and of node-hours per size tier, one row per program."""
    nh = F.col("nodes") * F.col("runtime_h")
    n_all, nh_all = F.count(F.lit(1)), F.sum(nh)
    cols = [(100.0 * F.count_if(F.col(tier) == t) / n_all).alias(f"{t}_count_pct") for t in tiers]
    cols += [F.try_divide(100.0 * F.coalesce(F.sum(F.when(F.col(tier) == t, nh)), F.lit(0.0)), nh_all).alias(f"{t}_nh_pct") for t in tiers]
    return df.groupBy(key).agg(*cols)


def describe_by(df: DataFrame, key: str, span_h: Column) -> DataFrame:
    """Profile per group: size, node-hours and their share, arrivals per day, distribution of size, walltime, runtime."""
    out = summarize(df, [key], {
        "jobs": F.count(F.lit(1)), "node_hours": F.sum(F.col("nodes") * F.col("runtime_h")),
        "nodes_mean": F.avg("nodes"), "nodes_max": F.max("nodes"), "runtime_mean": F.avg("runtime_h"),
        "rt_ratio_mean": F.avg("rt_ratio")},
        [(F.col("nodes"), {"nodes_p50": 0.5, "nodes_p90": 0.9, "nodes_p99": 0.99}),
         (F.col("walltime_h"), {"walltime_p50": 0.5, "walltime_p90": 0.9}), (F.col("runtime_h"), {"runtime_p50": 0.5})])
    total = df.agg(F.sum(F.col("nodes") * F.col("runtime_h"))).scalar()
    return out.withColumns({"nh_share": F.try_divide(F.col("node_hours"), total),
                            "arrivals_per_day": F.col("jobs") / (span_h / 24.0)})


def uplift(jobs: DataFrame, windows: Sequence[tuple[str, int, int]], days: int, submit: str = "submit_h") -> DataFrame:
    """Mean daily submissions inside each window (first and last day included) over the mean outside all windows."""
    per = jobs.groupBy(F.floor(F.col(submit) / 24).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    daily = fill_grid(per, [], ["n"], 0.0, float(days), 1.0)
    inside = {name: (F.col("bin") >= max(0, lo)) & (F.col("bin") <= min(days - 1, hi)) for name, lo, hi in windows}
    any_in = F.lit(False)
    for c in inside.values():
        any_in = any_in | c
    base = F.coalesce(F.avg(F.when(~any_in, F.col("n"))), F.avg("n"))
    one = daily.agg(base.alias("_base"), *[F.avg(F.when(c, F.col("n"))).alias(n) for n, c in inside.items()])
    return one.select("_base", F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(n).alias("inside"))
                                                   for n in inside])).alias("w")).select(
        "w.window", "w.inside", F.col("_base").alias("outside"), F.try_divide("w.inside", "_base").alias("uplift"))
