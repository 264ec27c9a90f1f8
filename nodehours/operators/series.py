"""Window populations, interval algebra and time series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodehours.blocks import asof, bin_sums, cut_points, grid, grid_levels, join_on, level_on_grid, n_covering, running, stored
from nodehours.functions import clean as C
from nodehours.functions.constants import PRODUCTION_NODES, TOTAL_NODES
from nodehours.operators.lookups import asof_step, nearest_within
from nodehours.operators.quantiles import summarize


# --------------------------------------------------------------------------
# population
# --------------------------------------------------------------------------


def _annotate(jobs: DataFrame, t0: float, t1: float, regex: str | None, queues: Sequence[str], max_run_count: int,
              grace: float, arrival: str) -> DataFrame:
    """Window overlap, exclusion flags, relative times and role of every trace row; drops nothing."""
    overlap = (F.col("start_h").isNotNull() & F.col("end_h").isNotNull() & (F.col("nodes") > 0)
               & (F.col("qtime_h") < t1) & (F.col("end_h") > t0))
    res = F.col("queue").rlike("^(?:" + regex + ")") if regex else F.lit(False)
    listed = F.col("queue").isin(list(queues)) if queues else F.lit(False)
    df = jobs.withColumns({"overlaps": F.coalesce(overlap, F.lit(False)), "is_res": F.coalesce(res, F.lit(False)),
                           "is_listed": F.coalesce(listed, F.lit(False)),
                           "is_requeued": F.coalesce(F.col("run_count"), F.lit(1)) > max_run_count})
    df = df.withColumn("kept", F.col("overlaps") & ~F.col("is_res") & ~F.col("is_listed") & ~F.col("is_requeued"))
    arrive = C.arrival("eligible_at_h", "qtime_h") if arrival == "etime" and "eligible_at_h" in df.columns else F.col("qtime_h")
    shift = F.lit(float(t0))
    df = df.withColumns({"submit_h": arrive - shift, "obs_start_h": F.col("start_h") - shift, "obs_end_h": F.col("end_h") - shift,
                         "ran_h": F.col("runtime_h"), "runtime_h": C.clip_runtime("runtime_h", "walltime_h", grace)})
    df = df.withColumn("qtime_h", F.col("qtime_h") - shift).withColumn("obs_wait_h", F.col("obs_start_h") - F.col("qtime_h"))
    running0 = (F.col("obs_start_h") < 0) & (F.col("obs_end_h") > 0)
    queued0 = (F.col("submit_h") < 0) & (F.col("obs_start_h") >= 0)
    role = F.when(running0, "running_at_t0").when(queued0, "queued_at_t0").when(F.col("submit_h") >= 0, "arrival")
    return df.withColumn("role", F.when(F.col("kept") & (F.col("walltime_h") > 0), role))


def population(jobs: DataFrame, t0: float, t1: float, exclude_regex: str | None = None, exclude_queues: Sequence[str] = (),
               max_run_count: int = 1, grace: float = 0.0, arrival: str = "etime") -> DataFrame:
    """Window population with roles and times relative to ``t0``; a projection and a filter, no shuffle.

    Input times are hours: qtime_h (submission), start_h, end_h and optionally
    eligible_at_h.  Scoring columns are default-filled.
    """
    df = _annotate(jobs, t0, t1, exclude_regex, exclude_queues, max_run_count, grace, arrival).where(F.col("role").isNotNull())
    df = df.withColumn("initial_start_h", F.when(F.col("role") == "running_at_t0", F.col("obs_start_h")))
    return C.fill_scoring(df).drop("overlaps", "is_res", "is_listed", "is_requeued", "kept", "ran_h")


def population_notes(jobs: DataFrame, t0: float, t1: float, exclude_regex: str | None = None,
                     exclude_queues: Sequence[str] = (), max_run_count: int = 1, grace: float = 0.0,
                     arrival: str = "etime") -> DataFrame:
    """Funnel of the population as one row, in one pass: counts and node-hour shares of each exclusion and role."""
    df = _annotate(jobs, t0, t1, exclude_regex, exclude_queues, max_run_count, grace, arrival)
    nh, over, res = F.col("nodes") * F.col("ran_h"), F.col("overlaps"), F.col("overlaps") & F.col("is_res")
    req = over & F.col("is_requeued") & ~F.col("is_res")
    total = F.greatest(F.sum(F.when(over, nh)), F.lit(1e-9))

    def share(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, nh)), F.lit(0.0)) / total

    arrived = F.col("role").isNotNull() & (F.col("submit_h") >= 0)
    return df.agg(
        F.count(F.lit(1)).alias("n_trace_rows"), F.count_if(over).alias("n_window_overlap"),
        F.count_if(res).alias("dropped_reservation_jobs"), share(res).alias("dropped_reservation_nh_frac"),
        F.count_if(req).alias("dropped_requeued_jobs"), share(req).alias("dropped_requeued_nh_frac"),
        F.count_if(F.col("kept") & F.col("has_depend")).alias("n_with_depend"),
        F.count_if(F.col("role") == "running_at_t0").alias("n_running_at_t0"),
        F.count_if(F.col("role") == "queued_at_t0").alias("n_queued_at_t0"), F.count_if(arrived).alias("n_arrivals"),
        F.count_if(F.col("role").isNotNull() & C.moved_arrival("submit_h", "qtime_h")).alias("n_moved"))


def censor(df: DataFrame, t1: float, start: str = "start_h", submit: str = "qtime_h") -> DataFrame:
    """Wait, its lower bound at the horizon for jobs not started, and the censor flag."""
    started = F.col(start).isNotNull()
    wait = F.col(start) - F.col(submit)
    return df.withColumns({"wait_h": wait, "wait_lb_h": F.when(started, wait).otherwise(F.lit(float(t1)) - F.col(submit)),
                           "censored": ~started})


# --------------------------------------------------------------------------
# busy nodes and utilisation
# --------------------------------------------------------------------------


def busy_timeline(df: DataFrame, t0: float, t1: float, dt: float, start: str = "start_h", end: str = "end_h",
                  nodes: str = "nodes", keys: Sequence[str] = ()) -> DataFrame:
    """Exact mean busy nodes and node-hours per bin; the last bin may be partial."""
    b = bin_sums(df, start, end, nodes, t0, t1, dt, keys)
    return b.select(*keys, "t_h", (F.col("total") / F.col("width_h")).alias("busy_nodes"), F.col("total").alias("node_hours"))


def node_hours(t0: float, t1: float, start: str = "start_h", end: str = "end_h", nodes: str = "nodes") -> Column:
    """Node-hours of a row inside [t0, t1)."""
    span = F.least(F.col(end), F.lit(float(t1))) - F.greatest(F.col(start), F.lit(float(t0)))
    known = F.col(start).isNotNull() & F.col(end).isNotNull()
    return F.when(known & (span > 0), F.col(nodes) * span).otherwise(0.0)


def utilization(df: DataFrame, t0: float, t1: float, denom: float, start: str = "start_h", end: str = "end_h",
                nodes: str = "nodes", keys: Sequence[str] = ()) -> DataFrame:
    """Delivered node-hours in [t0, t1) and their share of the capacity; one aggregation, no timeline.

    Without keys only overlapping rows are read; with keys every key keeps a row.
    """
    if not keys:
        df = df.where((F.col(start) < t1) & (F.col(end) > t0))
    s = F.coalesce(F.sum(node_hours(t0, t1, start, end, nodes)), F.lit(0.0))
    return df.groupBy(*keys).agg(s.alias("node_hours"), (s / F.lit((t1 - t0) * float(denom))).alias("utilization"))


def daily_utilization(df: DataFrame, t1: float, dt: float = 1.0, denom: float = PRODUCTION_NODES,
                      start: str = "start_h", end: str = "end_h") -> DataFrame:
    """Daily mean of the busy share sampled on a measurement grid."""
    lv = level_on_grid(df, start, end, "nodes", 0.0, t1, dt)
    return lv.groupBy(F.floor(F.col("t_h") / 24).cast("int").alias("day")).agg(F.avg(F.col("level") / denom).alias("util_frac"))


def queue_depth(df: DataFrame, t1: float, dt: float, by: str = "size_tier", submit: str = "submit_h",
                start: str = "start_h") -> DataFrame:
    """Jobs waiting (submit <= t < start) per tier at each grid point."""
    lv = level_on_grid(df, submit, start, None, 0.0, t1, dt, [by])
    return lv.select("t_h", by, F.round("level").cast("long").alias("depth"))


def delivered_over_time(df: DataFrame, t1: float, dt: float, by: Sequence[str] = ("program",), start: str = "start_h") -> DataFrame:
    """Cumulative node-hours per key at each grid point, credited in full at start."""
    by = list(by)
    cell = F.greatest(F.ceil(F.col(start) / F.lit(float(dt))), F.lit(0)).cast("long")
    sums = (df.where(F.col(start).isNotNull()).groupBy(*by, cell.alias("bin"))
            .agg(F.sum(F.col("nodes") * F.col("runtime_h")).alias("nh")))
    full = grid_levels(sums, by, [], {"delivered_nh": "nh"}, 0.0, t1, dt, closed=True)
    return full.select(*by, "t_h", "delivered_nh")


def telemetry(df: DataFrame, t1: float, dt: float, production: float = PRODUCTION_NODES) -> DataFrame:
    """Tidy long table (t_h, metric, program, value) of busy nodes, utilisation, depth and delivery."""
    lv = level_on_grid(df, "start_h", "end_h", "nodes", 0.0, t1, dt)
    wide = lv.select("t_h", F.col("level").alias("busy_nodes"), (F.col("level") / production).alias("utilization"))
    busy = wide.unpivot("t_h", ["busy_nodes", "utilization"], "metric", "value").withColumn("program", F.lit("_all"))
    depth = queue_depth(df, t1, dt).select("t_h", F.lit("queue_depth_tier").alias("metric"),
                                           F.col("size_tier").alias("program"), F.col("depth").cast("double").alias("value"))
    total = depth.groupBy("t_h").agg(F.sum("value").alias("value")).withColumns(
        {"metric": F.lit("queue_depth"), "program": F.lit("_all")})
    nh = delivered_over_time(df, t1, dt).select("t_h", F.lit("delivered_nh").alias("metric"), "program",
                                                F.col("delivered_nh").alias("value"))
    return busy.unionByName(depth).unionByName(total).unionByName(nh).select("t_h", "metric", "program", "value")


# --------------------------------------------------------------------------
# availability and concurrency
# --------------------------------------------------------------------------


def availability(series: DataFrame, windows: DataFrame, schedulable: float, t: str = "t_h", up: str = "up") -> DataFrame:
    """min(up, schedulable - reserved), floored at 0, at every break point.

    Up-changes and the starts and ends of windows are one set of events, netted per instant; the last up value and the
    reserved nodes are carried through it together, so the windows move once.  Of several values at one instant the
    largest counts; before the first one it holds already.
    """
    x = F.col("nodes").cast("double")
    none = F.lit(None).cast("double")
    edges = windows.select(F.explode(F.array(F.struct(F.col("start_h").cast("double").alias("t_h"), x.alias("d")),
                                             F.struct(F.col("end_h").cast("double").alias("t_h"), (-x).alias("d")))).alias("e"))
    edges = edges.where("e.t_h IS NOT NULL").select("e.t_h", none.alias("up"), "e.d")
    changes = series.select(F.col(t).cast("double").alias("t_h"), F.col(up).cast("double").alias("up"), F.lit(0.0).alias("d"))
    events = stored(changes.where("t_h IS NOT NULL").unionByName(edges).groupBy("t_h").agg(F.max("up").alias("up"), F.sum("d").alias("d")))
    first = events.agg(F.min_by("up", F.when(F.col("up").isNotNull(), F.col("t_h")))).scalar()
    a = running(events, [], "t_h", {"_up": ("last", "up"), "reserved": ("sum", "d")}, cuts=cut_points(events, "t_h"))
    a = a.select("t_h", F.coalesce("_up", first).alias("up"), "reserved")
    cap = F.lit(float(schedulable))
    return a.withColumn("available", F.greatest(F.lit(0.0), F.least(F.least(F.col("up"), cap), cap - F.col("reserved"))))


def mean_available(avail: DataFrame, t0: float, t1: float, dt: float = 0.25) -> DataFrame:
    """Mean of the availability sampled on a regular grid over [t0, t1)."""
    g = grid(avail.sparkSession, t0, t1, dt).select("t_h")
    return asof_step(g, avail, "t_h", "available").agg(F.avg("available").alias("mean_available"))


def concurrency(jobs: DataFrame, resv: DataFrame, t1: float, dt: float = 0.25, start: str = "start_h",
                end: str = "end_h") -> DataFrame:
    """Mean busy nodes per bin plus nodes reserved at the bin start."""
    b = bin_sums(jobs, start, end, "nodes", 0.0, t1, dt)
    r = level_on_grid(resv, "start_h", "end_h", "nodes", 0.0, t1, dt).select("bin", F.col("level").alias("reserved"))
    out = join_on(b, r, ["bin"], "left")
    busy = F.col("total") / F.col("width_h")
    return out.select("bin", "t_h", busy.alias("busy"), "reserved", (busy + F.col("reserved")).alias("concurrent"))


def capacity_estimate(conc: DataFrame, q: float = 0.995, margin: int = 0, total: int = TOTAL_NODES) -> DataFrame:
    """Quantile, maximum and mean of the concurrency, and the derived capacity min(total, round(q) + margin)."""
    s = summarize(conc, [], {"max_conc": F.max("concurrent"), "mean_busy": F.avg("busy")}, [(F.col("concurrent"), {"q_conc": q})])
    cap = F.least(F.lit(total), F.bround("q_conc").cast("long") + margin).cast("long")
    return s.select("q_conc", "max_conc", "mean_busy", cap.alias("capacity"))


def usable_series(snapshots: DataFrame, jobs: DataFrame, resv: DataFrame, t1: float, gap: float, dt: float = 0.25,
                  up: str = "up", before: float = 48.0, after: float = 200.0, otherwise: float | None = None) -> DataFrame:
    """Usable nodes on the grid: nearest snapshot within the gap, floored at the concurrency seen there.

    Only snapshots from ``before`` hours ahead of the window to ``after`` hours past it count. If the first
    of them comes later than ``gap`` they do not cover the window, and ``otherwise`` (if given) holds throughout.
    """
    snapshots = snapshots.where(F.col("t_h").between(-before, t1 + after))
    if otherwise is not None:
        first = snapshots.agg(F.min("t_h")).first()[0]
        if first is None or first > gap:
            points = snapshots.sparkSession.range(n_covering(0.0, t1, dt)).withColumnRenamed("id", "bin")
            return points.select("bin", (F.col("bin") * F.lit(float(dt))).alias("t_h"), F.lit(float(otherwise)).alias("usable"))
    conc = stored(concurrency(jobs, resv, t1, dt))  # grid-sized, read three times
    near = nearest_within(snapshots, 0.0, t1, dt, gap, value=up)
    lastbin = conc.agg(F.max("bin")).scalar()
    edge = conc.agg(F.max_by("concurrent", "bin")).scalar()
    out = join_on(near, conc.select("bin", "concurrent"), ["bin"], "left")
    seen = F.when(F.col("bin") > lastbin, edge).otherwise(F.col("concurrent"))
    return out.select("bin", "t_h", F.greatest(F.col(up), F.ceil(seen).cast("double")).alias("usable"))


# --------------------------------------------------------------------------
# what is free at an instant
# --------------------------------------------------------------------------


def free_profile(jobs: DataFrame, avail: DataFrame, now: float, horizon: float,
                 pools: Mapping[str, float] | None = None, pool: str = "pool", start: str = "start_h", end: str = "end_h", walltime: str = "walltime_h") -> DataFrame:
    """Free capacity over [now, horizon] per pool, if running jobs end at their requested end.

    Points are ``now``, the requested ends, the availability changes and the horizon.  ``pools`` maps dedicated pools to their size; rows with another
    value of ``pool`` use the general pool.  ``ahead`` is the running minimum.  A running job takes its nodes at ``now`` and
    gives them back at its end; these and the availability are one set of events, carried together.
    """
    pools = dict(pools or {})
    dedicated = float(sum(pools.values()))
    run = jobs.where((F.col(start) <= now) & (F.col(end) > now))
    name = F.col(pool) if pool in jobs.columns else F.lit("general")
    name = F.when(name.isin(list(pools)), name).otherwise("general") if pools else F.lit("general")
    names = F.array(F.lit("general"), *[F.lit(p) for p in pools])
    none, n = F.lit(None).cast("double"), F.col("nodes").cast("double")
    back = F.greatest(F.col(start) + F.col(walltime), F.lit(now + 1e-9))
    # every end is a point of all pools
    taken = run.select(F.explode(F.concat(F.array(F.struct(name.alias("pool"), F.lit(float(now)).alias("t_h"), (-n).alias("d"))), F.transform(
        names, lambda p: F.struct(p.alias("pool"), back.alias("t_h"), F.when(p == name, n).otherwise(0.0).alias("d"))))).alias("e"))
    taken = taken.select("e.*", none.alias("since"), none.alias("available")).where(F.col("t_h") <= horizon)
    # what holds at now is the last change up to it
    change = avail.select(F.explode(names).alias("pool"), F.greatest(F.col("t_h"), F.lit(float(now))).alias("t_h"), F.lit(0.0).alias("d"),
                          F.col("t_h").alias("since"), F.col("available").cast("double").alias("available"))
    # before the first change, its value holds
    first = avail.agg(F.min_by("available", "t_h")).scalar()
    ends = avail.sparkSession.range(1).select(F.explode(names).alias("pool")).select(
        "pool", F.explode(F.array(F.lit(float(now)), F.lit(float(horizon)))).alias("t_h"), F.lit(0.0).alias("d"), none.alias("since"), none.alias("available"))
    events = change.where(F.col("t_h") <= horizon).unionByName(taken).unionByName(ends)
    events = stored(events.groupBy("pool", "t_h").agg(F.sum("d").alias("d"), F.max_by("available", "since").alias("available")))
    cuts = cut_points(events, "t_h")
    a = running(events, ["pool"], "t_h", {"held": ("sum", "d"), "now": ("last", "available")}, cuts=cuts)
    up = F.coalesce("now", first)
    cap = F.greatest(up - dedicated, F.lit(0.0))
    for p, size in pools.items():
        cap = F.when(F.col("pool") == p, F.least(up, F.lit(float(size)))).otherwise(cap)
    a = a.select("pool", "t_h", F.floor(cap + F.col("held") + F.lit(1e-9)).cast("double").alias("free"))
    return running(a, ["pool"], "t_h", {"ahead": ("min", "free")}, cuts=cuts).select("pool", "t_h", "free", "ahead")


def release_time(requests: DataFrame, running_jobs: DataFrame, free: float, now: float, nodes: str = "nodes",
                 walltime: str = "walltime_h", start: str = "start_h", name: str = "release_h") -> DataFrame:
    """Earliest time cumulative releases make the requested nodes available, else now + walltime."""
    ends = (running_jobs.groupBy((F.col(start) + F.col(walltime)).alias("end_t")).agg(F.sum(F.col("nodes").cast("double")).alias("n")))
    cum = running(ends, [], "end_t", {"upto": ("sum", "n")})
    cum = cum.groupBy((F.col("upto") + F.lit(float(free))).alias("_need")).agg(F.min("end_t").alias("_end"))
    req = requests.withColumn("_need", F.col(nodes).cast("double"))
    hit = asof(req, cum, "_need", ["_end"], direction="forward")
    t = F.when(F.col(nodes) <= free, F.lit(float(now))).otherwise(F.coalesce(F.col("_end"), F.lit(float(now)) + F.col(walltime)))
    return hit.withColumn(name, t).drop("_need", "_end")
