"""Lookups: routing, step series, nearest, intervals, caps and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodehours.blocks import (BLK, GRID_BLOCK, asof, dim_rows, following, grid_running, join_on, last_at, n_covering, numbered, running,
                              small_side, step_arrays, stored, struct_array, with_block)


def with_queue(df: DataFrame, queues: DataFrame, defaults: dict[str, object], key: str = "queue") -> DataFrame:
    """Queue attributes by name; unknown queues and NULL attributes take the default (None: no limit).

    The menu is broadcast when its counted size allows.
    """
    attrs = queues.select(F.col("name").alias(key), *defaults)
    out = join_on(df, small_side(attrs), [key], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if v is not None else F.col(c) for c, v in defaults.items()})


def route(df: DataFrame, queues: DataFrame, nodes: str = "nodes", walltime: str = "walltime_h",
          name: str = "routed") -> DataFrame:
    """The routable queue accepting the job: smallest node range, then name; NULL if none.

    The menu is a size-checked configuration table and enters as a literal, so
    the job rows are neither shuffled nor multiplied.
    """
    menu = queues.where("routable").select(
        (F.col("max_nodes") - F.col("min_nodes")).alias("width"), "name", "min_nodes", "max_nodes", "max_walltime_h")
    arr = struct_array(dim_rows(menu, menu.columns), "width int, name string, lo int, hi int, cap double")
    fits = F.filter(arr, lambda q: (q["lo"] <= F.col(nodes)) & (F.col(nodes) <= q["hi"])
                    & (F.col(walltime) <= q["cap"] + F.lit(1e-9)))
    best = F.array_min(F.transform(fits, lambda q: F.struct(q["width"].alias("w"), q["name"].alias("n"))))
    return df.withColumn(name, best["n"])


def walltime_cap(nodes: Column | str, breakpoints: Sequence[tuple[int, float]], fallback: Column | float) -> Column:
    """Cap of the highest breakpoint at or below the node count, else the fallback."""
    n = F.col(nodes) if isinstance(nodes, str) else nodes
    fb = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    if not breakpoints:
        return fb
    arr = struct_array(sorted(breakpoints, key=lambda b: b[0]), "lo int, cap double")
    hit = F.try_element_at(F.filter(arr, lambda b: b["lo"] <= n), F.lit(-1))
    return F.coalesce(hit["cap"], fb)


def smallest_nodes_for(nodes: Column | str, walltime: Column | str, breakpoints: Sequence[tuple[int, float]],
                       ceiling: int) -> Column:
    """Smallest size, not below the current one nor above the ceiling, whose cap admits the walltime."""
    n = F.col(nodes) if isinstance(nodes, str) else nodes
    w = F.col(walltime) if isinstance(walltime, str) else walltime
    arr = struct_array(sorted(breakpoints, key=lambda b: b[0]), "lo int, cap double")
    lows = F.transform(F.filter(arr, lambda b: (b["cap"] >= w) & (b["lo"] <= ceiling)), lambda b: b["lo"])
    best = F.array_min(lows)
    size = F.when(best.isNotNull(), F.greatest(best, n))
    return F.when(size <= ceiling, size)


def deadline_mult(df: DataFrame, windows: Sequence[tuple[str, float, float, float]], affected: DataFrame | None = None,
                  t: str = "submit_h", project: str = "project", name: str = "mult") -> DataFrame:
    """Product of the multipliers of all windows (name, start, end, factor) covering t.

    ``affected`` lists (window, project); without it every project is affected.
    """
    arr = struct_array(windows, "name string, s double, e double, m double")
    covers = F.filter(arr, lambda w: (w["s"] <= F.col(t)) & (F.col(t) <= w["e"]))
    if affected is not None:
        # at most one entry per window and project, so the set is bounded by the windows
        per = affected.groupBy(project).agg(F.collect_set("window").alias("_aff"))
        df = join_on(df, per, [project], "left")
        covers = F.filter(covers, lambda w: F.coalesce(F.array_contains(F.col("_aff"), w["name"]), F.lit(False)))
    prod = F.aggregate(covers, F.lit(1.0), lambda acc, w: acc * w["m"])
    return df.withColumn(name, prod).drop("_aff")


def overlapping(df: DataFrame, t0: Column | float, t1: Column | float, start: str = "start_h", end: str = "end_h",
                states: Sequence[str] = (), nodes: str | None = "nodes") -> DataFrame:
    """Intervals that overlap (t0, t1); plain comparisons, so they reach the parquet scan."""
    cond = (F.col(start) < t1) & (F.col(end) > t0)
    if states:
        cond = cond & F.col("state").isin(list(states))
    if nodes:
        cond = cond & (F.col(nodes) > 0)
    return df.where(cond)


# --------------------------------------------------------------------------
# step series and interval cover
# --------------------------------------------------------------------------


def asof_step(df: DataFrame, series: DataFrame, on: str, value: str, t: str = "t_h", dimension: bool = False) -> DataFrame:
    """Value of a step series at ``on``; before the first row the first value holds, and a NULL instant has none.

    A series declared a ``dimension`` is held as one sorted array per block of it: each row joins the array of its
    block and finds its step there by binary search.  The arrays are broadcast, and the rows not moved, as long as
    their counted size allows; beyond it one shuffle by block brings both together.  Otherwise both sides are cut
    into blocks of rows.
    """
    if dimension:
        kind = series.schema[value].dataType
        steps = step_arrays(series.groupBy(F.col(t).cast("double").alias("t")).agg(F.max(value).alias("v")), "t", "v")
        # a series of one block has a literal for its number, which alone would be no key to join by
        at = F.when(F.col(on).isNotNull(), F.col("_step"))
        found = with_block(df, on, steps.cuts, "_step").join(
            steps.side(F.col("ts").alias("_ts"), F.col("vs").alias("_vs")), at == F.col(BLK), "left")
        hit = F.when(F.col(on).isNotNull(), F.get("_vs", last_at(F.col("_ts"), F.col(on).cast("double")) - 1))
        return found.select(*[found[c] for c in df.columns if c != value], hit.cast(kind).alias(value))
    right = series.select(F.col(t).alias(on), value)
    first = series.agg(F.min_by(value, t)).scalar()
    return asof(df, right, on, [value]).withColumn(value, F.when(F.col(on).isNotNull(), F.coalesce(F.col(value), first)))


def step_levels(intervals: DataFrame, start: str, end: str, weight: str | None, keys: Sequence[str] = (),
                name: str = "level") -> DataFrame:
    """Total weight of the intervals covering t, as a step series with one row per change."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    deltas = (intervals.where(F.col(start).isNotNull())
              .select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t_h"), w.alias("d")),
                                               F.struct(F.col(end).alias("t_h"), (-w).alias("d")))).alias("p"))
              .select(*keys, "p.*").where(F.col("t_h").isNotNull())
              .groupBy(*keys, "t_h").agg(F.sum("d").alias("d")))
    return running(deltas, keys, "t_h", {name: ("sum", "d")}).select(*keys, "t_h", name)


def covering_sum(instants: DataFrame, intervals: DataFrame, on: str, start: str = "start_h", end: str = "end_h",
                 weight: str = "nodes", name: str = "covered") -> DataFrame:
    """Sum of sizes of the intervals [start, end) covering each instant; NULL for a NULL instant."""
    levels = stored(step_levels(intervals, start, end, weight, name=name)).withColumnRenamed("t_h", on)
    return asof(instants, levels, on, [name]).withColumn(name, F.when(F.col(on).isNotNull(), F.coalesce(F.col(name), F.lit(0.0))))


# --------------------------------------------------------------------------
# regular grids: neighbours through one row per grid cell
# --------------------------------------------------------------------------


def grid_neighbours(series: DataFrame, t0: float, t1: float, dt: float, t: str = "t_h", value: str = "value") -> DataFrame:
    """For the points t0, t0+dt, .. until the first at or past t1: last series row at or before, first row after.

    The series is reduced to the first and last row of each grid cell on the
    map side; only grid-sized data is ordered.
    """
    n = n_covering(t0, t1, dt) - 1
    cell = F.ceil((F.col(t) - F.lit(float(t0))) / F.lit(float(dt)))
    cell = F.least(F.greatest(cell, F.lit(0)), F.lit(n + 1)).cast("long")
    x, v = F.col(t), F.col(value).cast("double")
    cells = (series.where(x.isNotNull()).groupBy(cell.alias("bin"))
             .agg(F.max(x).alias("t1"), F.max_by(v, x).alias("v1"), F.min(x).alias("t0"), F.min_by(v, x).alias("v0")))

    def pair(a, b):
        return F.when(F.col(a).isNotNull(), F.struct(F.col(a).alias("t"), F.col(b).alias("v")))

    cells = cells.select("bin", pair("t1", "v1").alias("_last"), pair("t0", "v0").alias("_first"))
    # one extra cell behind the last point holds the rows after it
    points = series.sparkSession.range(n + 2).withColumnRenamed("id", "bin")
    g = join_on(points, cells, ["bin"], "left")
    g = grid_running(g, [], {"back": ("last", "_last")}, n + 2)
    # the first row after a point lies in the nearest later cell that has one
    g = g.withColumn("_rev", F.lit(n + 1) - F.col("bin"))
    g = grid_running(g, [], {"ahead": ("last", "_first")}, n + 2, order="_rev")
    if n + 2 <= GRID_BLOCK:  # the grid length bounds this window
        g = g.withColumn("fwd", F.lead("ahead").over(Window.orderBy("bin")))
    else:
        g = join_on(g, g.select((F.col("bin") - 1).alias("bin"), F.col("ahead").alias("fwd")), ["bin"], "left")
    t_h = F.lit(float(t0)) + F.col("bin") * F.lit(float(dt))
    return g.where(F.col("bin") <= n).select("bin", t_h.alias("t_h"), "back", "fwd")


def nearest_within(series: DataFrame, t0: float, t1: float, dt: float, gap: float, t: str = "t_h",
                   value: str = "value", horizon: float | None = None) -> DataFrame:
    """Nearest series value at each grid point if within ``gap``, else the typical value.

    Typical is the 75th percentile of the values inside [t0, horizon], or the
    median of all when the window holds none.
    """
    from nodehours.operators.quantiles import quantiles

    h = t1 if horizon is None else horizon
    inside = series.where((F.col(t) >= t0) & (F.col(t) <= h))
    typical = F.coalesce(quantiles(inside, [], value, {"q": 0.75}).scalar(),
                         quantiles(series, [], value, {"q": 0.5}).scalar())
    g = grid_neighbours(series, t0, t1, dt, t, value)
    gb, gf = F.col("t_h") - F.col("back.t"), F.col("fwd.t") - F.col("t_h")
    use_fwd = F.col("back").isNull() | (gf < gb)
    near = F.when(F.col("fwd").isNotNull() & use_fwd, F.struct(gf.alias("g"), F.col("fwd.v").alias("v"))).otherwise(
        F.struct(gb.alias("g"), F.col("back.v").alias("v")))
    g = g.withColumn("_n", near)
    val = F.when(F.col("_n.g") <= F.lit(float(gap)), F.col("_n.v")).otherwise(typical)
    return g.select("bin", "t_h", F.col("_n.g").alias("gap_h"), val.alias(value))


def interpolate(series: DataFrame, t0: float, t1: float, dt: float, t: str = "t_h", value: str = "value") -> DataFrame:
    """Linear interpolation at each grid point, flat beyond the ends of the series."""
    g = grid_neighbours(series, t0, t1, dt, t, value)
    b, f, x = F.col("back"), F.col("fwd"), F.col("t_h")
    lerp = b["v"] + (f["v"] - b["v"]) * (x - b["t"]) / (f["t"] - b["t"])
    return g.select("bin", "t_h", F.when(b.isNull(), f["v"]).when(f.isNull(), b["v"]).otherwise(lerp).alias(value))


# --------------------------------------------------------------------------
# requests against a profile
# --------------------------------------------------------------------------


def earliest_fit(requests: DataFrame, profile: DataFrame, nodes: str = "nodes", length: str = "walltime_h",
                 t: str = "t_h", free: str = "free", name: str = "fit_h") -> DataFrame:
    """First profile time from which ``free`` stays >= nodes for the whole length; NULL if never.

    Each requested size cuts the profile into runs of sufficient capacity; only
    flips are emitted.  Per size the runs longer than every earlier run are
    kept, and each distinct request finds the first that is long enough by an
    as-of on the length per size, in length blocks, so a popular size is spread
    over them.  Runs that reach the end of the profile count as endless; the
    last point itself is no start.
    """
    sizes = numbered(requests.select(F.col(nodes).cast("double").alias("size")).where("size IS NOT NULL").distinct(), [], "size", name="lvl")
    sizes = stored(sizes.withColumn("lvl", F.col("lvl").cast("int")))
    prof = stored(profile.select(F.col(t).alias("t"), F.col(free).cast("double").alias("f")))
    last = prof.agg(F.max("t")).scalar()
    # c: how many of the sorted sizes fit at t
    fits = asof(prof, sizes.select(F.col("size").alias("f"), F.col("lvl").alias("c")), "f", ["c"]).withColumn("c", F.coalesce("c", F.lit(0)))
    seg = following(stored(fits), [], "t", {"c0": "c"}, -1).withColumn("c0", F.coalesce("c0", F.lit(0)))
    lo, hi = F.least("c", "c0"), F.greatest("c", "c0")
    flips = seg.where(F.col("c") != F.col("c0")).select(
        F.explode(F.sequence(lo + 1, hi)).alias("lvl"), "t", (F.col("c") > F.col("c0")).alias("up"))
    run = following(flips, ["lvl"], "t", {"end": "t"}).where(F.col("up") & (F.col("t") < last))
    run = run.select("lvl", "t", (F.coalesce("end", F.lit(float("inf"))) - F.col("t")).alias("len"))
    best = running(run, ["lvl"], "t", {"top": ("max", "len")}).groupBy("lvl", F.col("top").alias("len")).agg(F.min("t").alias("t"))
    req = requests.select(F.col(nodes).cast("double").alias("_n"), F.col(length).cast("double").alias("_l")).distinct()
    req = req.join(small_side(sizes), F.col("_n") == F.col("size")).select("lvl", "_n", "_l", (F.col("_l") - F.lit(1e-9)).alias("len"))
    # the kept runs of a size get longer as they get later: the shortest that is long enough is the earliest
    hit = asof(stored(req), stored(best), "len", ["t"], keys=["lvl"], direction="forward").select("_n", "_l", F.col("t").alias(name))
    out = requests.withColumn("_n", F.col(nodes).cast("double")).withColumn("_l", F.col(length).cast("double"))
    return join_on(out, hit, ["_n", "_l"], "left").drop("_n", "_l")


# --------------------------------------------------------------------------
# cap audit
# --------------------------------------------------------------------------


def cap_audit(jobs: DataFrame, queues: DataFrame, start: str = "start_h", end: str = "end_h",
              limits: dict[str, str] | None = None) -> DataFrame:
    """Peak concurrency per limit scope against the queue limits.

    Scopes: ``user`` and ``project`` count jobs per (queue, entity), ``queue``
    sums nodes.  At equal times ends are taken before starts, so the events of
    one instant are netted before anything is ordered.  Pass the submission
    time as ``start`` to audit queued + running.
    """
    limits = limits or {"user": "max_run_per_user", "project": "max_run_per_project", "queue": "max_nodes_total"}
    ok = F.col(start).isNotNull() & (F.coalesce(F.col(end), F.lit(float("inf"))) > F.col(start))
    scopes = []
    for s in limits:
        entity = F.lit("*") if s == "queue" else F.col(s).cast("string")
        size = F.col("nodes").cast("long") if s == "queue" else F.lit(1).cast("long")
        scopes.append(F.struct(F.lit(s).alias("scope"), entity.alias("entity"), size.alias("size")))
    rows = jobs.where(ok).select("queue", F.col(start).alias("a"), F.col(end).alias("b"), F.explode(F.array(*scopes)).alias("s"))
    ev = rows.select("queue", "s.*", F.explode(F.array(
        F.struct(F.col("a").alias("t"), F.lit(1).alias("sign")), F.struct(F.col("b").alias("t"), F.lit(-1).alias("sign")))).alias("e"))
    keys = ["scope", "queue", "entity"]
    net = (ev.where(F.col("e.t").isNotNull()).groupBy(*keys, F.col("e.t").alias("t"))
           .agg(F.sum(F.col("size") * F.col("e.sign")).alias("d"), F.count_if(F.col("e.sign") > 0).alias("starts")))
    run = running(net, keys, "t", {"level": ("sum", "d")})
    caps = queues.select(F.col("name").alias("queue"), F.explode(F.array(*[
        F.struct(F.lit(s).alias("scope"), F.col(c).cast("long").alias("cap")) for s, c in limits.items()])).alias("c"))
    out = join_on(run, small_side(caps.select("queue", "c.*")), ["queue", "scope"], "left")
    return out.groupBy(*keys).agg(F.max("level").alias("peak"), F.max("cap").alias("cap"),
                                  F.sum(F.when((F.col("level") > F.col("cap")), F.col("starts")).otherwise(0)).alias("starts_over"))
