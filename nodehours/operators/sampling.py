"""Reproducible sampling: every draw is a hash of its key and seed, so results do not depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodehours.blocks import join_on, n_bins, numbered, small_side, stored, struct_array, uniform
from nodehours.functions import clean as C
from nodehours.functions.constants import SCENARIOS, SIZE_TIERS
from nodehours.operators.lookups import smallest_nodes_for, walltime_cap


# --------------------------------------------------------------------------
# row bootstrap
# --------------------------------------------------------------------------


def _clipped_run() -> Column:
    return F.least(F.greatest(F.col("rt_ratio") * F.col("walltime_h"), F.lit(0.05)), F.col("walltime_h"))


def _draw(requests: DataFrame, indexed: DataFrame, pool: Sequence[str]) -> DataFrame:
    out = join_on(requests, indexed, pool, "left")
    return out.withColumn("runtime_h", _clipped_run())


def _replicated(requests: DataFrame, seed: int | Sequence[int]) -> tuple[DataFrame, Column]:
    """The requests once for each seed of a list, with a column seed; a single seed adds none."""
    if isinstance(seed, int):
        return requests, F.lit(str(seed))
    return requests.withColumn("seed", F.explode(F.array(*[F.lit(int(x)) for x in seed]))), F.col("seed").cast("string")


def cell_pools(profile: DataFrame, row_id: str = "job_id") -> DataFrame:
    """Profile rows with a dense index per size-tier cell and per program, and a number _row over all pools, one pool after the other; written once, any number of draws reads it."""
    pools = profile.select(row_id, "nodes", "walltime_h", "rt_ratio", F.col("program").alias("_p"), F.explode(F.array(
        F.struct(F.col("alloc_off").alias("_o"), F.col("size_tier").alias("_t")),
        F.struct(F.lit(-1).alias("_o"), F.lit("*").alias("_t")))).alias("k")).select("*", "k.*").drop("k")
    pool = ["_p", "_o", "_t"]
    rows = stored(numbered(pools, pool, row_id, name="_idx").withColumnRenamed(row_id, "source_id"))
    sizes = rows.groupBy(*pool).agg(F.count(F.lit(1)).alias("_n"))
    # one row per pool
    before = Window.partitionBy(F.lit(0)).orderBy(*pool).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*pool, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rows = join_on(rows, small_side(base), pool)
    return stored(rows.withColumn("_row", F.col("_base") + F.col("_idx")).drop("_base"))


def project_pools(profile: DataFrame, row_id: str = "job_id", pool: str = "project") -> DataFrame:
    """Profile rows with a dense index per project, written once."""
    rows = numbered(profile.select(row_id, pool, "nodes", "walltime_h", "rt_ratio"), [pool], row_id, name="_idx")
    return stored(rows.withColumnRenamed(row_id, "source_id"))


def bootstrap(requests: DataFrame, profile: DataFrame | None, min_rows: int, seed: int | Sequence[int], ident: str | Sequence[str] = "req_id",
              row_id: str = "job_id", pools: DataFrame | None = None) -> DataFrame:
    """Draw whole profile rows for requests (ident, program, alloc_off).

    A size-tier cell of the month offset is chosen in proportion to its rows,
    then one row of it; a cell below ``min_rows`` (or an offset without rows)
    falls back to all rows of the program.  Rows carry a dense index per pool
    built from id blocks and, with the rows of the pools before, one number: a draw is an equi-join on it.  A request
    of a program without profile rows comes back with NULLs.

    With a list of seeds every request is drawn once for each (column seed); the
    draw of one seed is the same as on its own.  Requests are repeated only after
    they met the sizes of their cells, and the pools, which ``cell_pools`` writes
    once for any number of calls, are shuffled once for all seeds and design
    points.  Name design columns in ``ident`` for draws that differ between
    designs; otherwise a request draws alike in all of them.
    """
    idents = [ident] if isinstance(ident, str) else list(ident)
    pools = cell_pools(profile, row_id) if pools is None else pools
    own = pools.where("_o >= 0")
    sizes = own.groupBy(F.col("_p").alias("program"), F.col("_o").alias("alloc_off"), F.col("_t").alias("size_tier")).agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first"))
    # at most one row per tier and offset
    upto = Window.partitionBy("program", "alloc_off").orderBy("size_tier")
    cells = (sizes.withColumn("cum", F.sum("n").over(upto)).groupBy("program", "alloc_off")
             .agg(F.array_sort(F.collect_list(F.struct("cum", "n", "first"))).alias("_cells"), F.sum("n").alias("_total")))
    parents = pools.where("_o < 0").groupBy(F.col("_p").alias("program")).agg(F.count(F.lit(1)).alias("_parent"), F.min("_row").alias("_first"))
    req = join_on(join_on(requests, small_side(cells), ["program", "alloc_off"], "left"), small_side(parents), ["program"], "left")
    req, one = _replicated(req, seed)
    target = F.floor(uniform(*idents, seed=F.concat(F.lit("cell"), one)) * F.col("_total"))
    pick = F.try_element_at(F.filter("_cells", lambda c: c["cum"] > target), F.lit(1))
    req = req.withColumn("_pick", pick)
    thick = F.coalesce(F.col("_pick.n") >= min_rows, F.lit(False))
    size = F.when(thick, F.col("_pick.n")).otherwise(F.col("_parent"))
    kept = [c for c in req.columns if c not in ("_cells", "_total", "_parent", "_first", "_pick")]
    first = F.when(thick, F.col("_pick.first")).otherwise(F.col("_first"))
    req = req.select(*kept, thick.alias("_thick"), (F.floor(uniform(*idents, seed=F.concat(F.lit("row"), one)) * size) + first).alias("_row"))
    out = _draw(req, pools.drop("_p", "_o", "_t", "_idx"), ["_row"])
    return out.withColumn("pool", F.when(F.col("source_id").isNull(), F.lit(None)).when(F.col("_thick"), "cell").otherwise("program")).drop("_thick", "_row")


def bootstrap_project(requests: DataFrame, profile: DataFrame | None, seed: int | Sequence[int], ident: str | Sequence[str] = "req_id",
                      row_id: str = "job_id", pool: str = "project", pools: DataFrame | None = None) -> DataFrame:
    """Draw whole profile rows per project for requests (ident, project); NULLs where a project has none.

    Seeds, ``ident`` and ``pools`` (of ``project_pools``) work as in ``bootstrap``.
    """
    idents = [ident] if isinstance(ident, str) else list(ident)
    pools = project_pools(profile, row_id, pool) if pools is None else pools
    sizes = pools.groupBy(pool).agg(F.count(F.lit(1)).alias("_n"))
    req, one = _replicated(join_on(requests, small_side(sizes), [pool], "left"), seed)
    req = req.withColumn("_idx", F.floor(uniform(*idents, seed=F.concat(F.lit("row"), one)) * F.col("_n")) + 1).drop("_n")
    return _draw(req, pools, [pool, "_idx"]).drop("_idx")


# --------------------------------------------------------------------------
# synthetic draws
# --------------------------------------------------------------------------


def cumulative(mix: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """(value, upper edge of its share of [0, 1)) in the listed order; the last edge is open."""
    total = sum(w for _, w in mix)
    edge, out = 0.0, []
    for v, w in mix:
        edge += w / total
        out.append((v, edge))
    return [*out[:-1], (out[-1][0], math.inf)]


def weighted_choice(u: Column, mix: Sequence[tuple[float, float]], kind: str = "double") -> Column:
    arr = struct_array(cumulative(mix), f"v {kind}, edge double")
    return F.try_element_at(F.filter(arr, lambda x: u < x["edge"]), F.lit(1))["v"]


def scenario_draws(df: DataFrame, scenario: str, seed: int, ident: str = "req_id") -> DataFrame:
    """Nodes, walltime and clipped-normal runtime ratio of a synthetic program, one draw per row."""
    nodes, walls, mean, spread = SCENARIOS[scenario]
    u = {k: uniform(ident, seed=f"{k}{seed}") for k in ("n", "w", "a", "b")}
    z = F.sqrt(-2 * F.ln(1 - u["a"])) * F.cos(2 * math.pi * u["b"])
    ratio = F.least(F.greatest(F.lit(mean) + F.lit(spread) * z, F.lit(0.05)), F.lit(1.0))
    return (df.withColumns({"nodes": weighted_choice(u["n"], nodes, "int"), "walltime_h": weighted_choice(u["w"], walls),
                            "rt_ratio": ratio}).withColumn("runtime_h", _clipped_run()))


# --------------------------------------------------------------------------
# arrivals
# --------------------------------------------------------------------------


def affected_projects(projects: DataFrame, windows: Sequence[str], fraction: float, seed: int,
                      project: str = "project") -> DataFrame:
    """Per deadline window the k = max(1, round(fraction x projects)) projects with the smallest draw."""
    ids = projects.select(project).distinct()
    total = ids.agg(F.count(F.lit(1))).scalar()
    rows = ids.select(project, F.explode(F.array(*[F.lit(w) for w in windows])).alias("window"))
    rows = rows.withColumn("_u", uniform("window", project, seed=seed))
    rows = numbered(rows, ["window"], "_u", [project], "_rn")
    k = F.greatest(F.lit(1), F.bround(F.lit(float(fraction)) * total).cast("long"))
    return rows.where(F.col("_rn") <= k).select("window", project)


def deadline_windows(deadlines: DataFrame, start_month: int, days: float) -> DataFrame:
    """Windows (name, start_h, end_h, mult) of a calendar of deadlines (name, month, day, lead_days, mult), one for each year they touch.

    Months have 30 days and are counted from ``start_month``; years have 365. A window lasts ``lead_days`` up to the start of
    its day. Later years carry their number in the name, and windows outside a run of ``days`` are left out.
    """
    day = 30 * F.pmod(F.col("month") - start_month, F.lit(12)) + F.col("day") - 1 + 365 * F.col("year")
    yearly = deadlines.withColumn("year", F.explode(F.sequence(F.lit(0), F.lit(int(days // 365)))))
    spans = yearly.select(F.concat("name", F.when(F.col("year") > 0, F.concat(F.lit("+"), F.col("year").cast("string"))).otherwise("")).alias("name"),
                          (24.0 * (day - F.col("lead_days"))).alias("opens"), (24.0 * day).alias("end_h"), "mult")
    return spans.where((F.col("end_h") >= 0) & (F.col("opens") <= 24.0 * days)).select(
        "name", F.greatest(F.col("opens"), F.lit(0.0)).alias("start_h"), "end_h", "mult")


def expected_arrivals(rates: DataFrame, curve: DataFrame, duration_h: float, dt: float, start_month: int,
                      entity: str = "program", windows: Sequence[tuple[str, float, float, float]] = (),
                      affected: DataFrame | None = None, load: float = 1.0) -> DataFrame:
    """Expected arrivals per entity and bin: base x seasonal x deadline x load x width.

    ``rates`` holds entity, program, rate_h and start_month of the allocation
    year; ``curve`` holds program, alloc_off and mult.  The rate of a bin is the
    rate at its start, so choose ``dt`` to divide months and windows.
    """
    n = n_bins(0.0, duration_h, dt)
    bins = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("bin")
    g = rates.select(*dict.fromkeys([entity, "program"]), "rate_h", "start_month", bins)
    g = g.withColumn("t_h", F.col("bin") * F.lit(float(dt)))
    g = g.withColumn("alloc_off", C.alloc_offset(C.cal_month_at("t_h", start_month), F.col("start_month")))
    g = join_on(g, small_side(curve.select("program", "alloc_off", "mult")), ["program", "alloc_off"], "left")
    g = g.withColumnRenamed("mult", "_season")
    if windows:
        from nodehours.operators.lookups import deadline_mult

        g = deadline_mult(g, windows, affected, t="t_h", project=entity, name="_dl")
    else:
        g = g.withColumn("_dl", F.lit(1.0))
    rate = F.col("rate_h") * F.coalesce(F.col("_season"), F.lit(1.0)) * F.col("_dl") * F.lit(float(load))
    width = F.least(F.lit(float(dt)), F.lit(float(duration_h)) - F.col("t_h"))
    return g.select(*dict.fromkeys([entity, "program"]), "bin", "t_h", "alloc_off", width.alias("width_h"),
                    rate.alias("rate_h"), (rate * width).alias("expected"))


# Poisson terms checked per slice: with a mean of at most one, the chance of more
# than 20 arrivals is far below 2^-52, the resolution of a draw, so none is lost.
POISSON_TERMS = 20
SLICES = 65536  # slices one row is expanded into


def poisson_cdf(lam: Column) -> Column:
    """Array of the first POISSON_TERMS values of the Poisson distribution function."""
    p0 = F.exp(-lam)
    start = F.struct(p0.alias("p"), p0.alias("top"), F.array(p0).alias("cdf"))

    def step(acc, i):
        p = acc["p"] * lam / i
        return F.struct(p.alias("p"), (acc["top"] + p).alias("top"), F.array_append(acc["cdf"], acc["top"] + p).alias("cdf"))

    terms = F.array(*[F.lit(float(k)) for k in range(1, POISSON_TERMS)])
    return F.aggregate(terms, start, step)["cdf"]


def draw_arrivals(expected: DataFrame, seeds: Sequence[int], entity: str = "program") -> DataFrame:
    """Poisson arrivals of the binned rate, for all seeds in one job.

    A bin is cut into slices with a mean of at most one arrival.  Slices are
    independent, so the count comes from one draw by inversion and each arrival
    time is uniform in its slice; no running sum is needed.  The small rate
    table is spread over all tasks before it is expanded, in chunks of slices,
    so one hot entity or bin is many tasks' work.
    """
    tasks = int(expected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = expected.where(F.col("expected") > 0).withColumn("_k", F.ceil("expected").cast("long"))
    e = e.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    e = e.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_k") - 1) / SLICES))))
    e = e.repartition(tasks, entity, "bin", "seed", "_c")
    e = e.withColumn("_cdf", poisson_cdf(F.col("expected") / F.col("_k")))  # once per row, before slices
    first = F.col("_c") * SLICES
    e = e.withColumn("_s", F.explode(F.sequence(first, F.least(first + (SLICES - 1), F.col("_k") - 1))))
    e = e.withColumn("_u", uniform(entity, "bin", "_s", "seed", seed="count"))
    count = F.lit(0)
    for k in range(POISSON_TERMS):
        count = count + F.when(F.col("_u") >= F.col("_cdf")[k], 1).otherwise(0)
    e = e.withColumn("_n", count)
    e = e.withColumn("_j", F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(1), F.col("_n")))))
    w = F.col("width_h") / F.col("_k")
    t = F.col("t_h") + w * (F.col("_s") + uniform(entity, "bin", "_s", "_j", "seed", seed="time"))
    return e.select(*dict.fromkeys([entity, "program"]), "seed", "alloc_off", t.alias("submit_h"))


# --------------------------------------------------------------------------
# demand response
# --------------------------------------------------------------------------


def respond(df: DataFrame, breakpoints: Sequence[tuple[int, float]], seed: int, adapt: float = 0.3,
            by_program: Mapping[str, float] | None = None, max_nodes: int = 1920, min_walltime: float = 24.0,
            tiers: Sequence[tuple] = SIZE_TIERS, ident: str = "req_id") -> DataFrame:
    """Resize some jobs up to unlock their walltime, then cap walltime and scale the run."""
    def cap(n: Column) -> Column:
        return walltime_cap(n, breakpoints, C.tier_value(n, tiers, 3))

    frac = F.lit(float(adapt))
    for p, f in (by_program or {}).items():
        frac = F.when(F.col("program") == p, F.lit(float(f))).otherwise(frac)
    n, w, r = F.col("nodes"), F.col("walltime_h"), F.col("runtime_h")
    wants = (w >= min_walltime) & (uniform(ident, seed=seed) < frac) & (cap(n) < w)
    bigger = smallest_nodes_for(n, w, breakpoints, max_nodes)
    size = F.when(wants & bigger.isNotNull(), bigger).otherwise(n)
    out = df.withColumn("_n", size).withColumn("_cap", cap(F.col("_n")))
    wall = F.least(w, F.col("_cap"))
    ratio = F.when(w > 0, r / w).otherwise(1.0)
    run = F.least(F.when(w > F.col("_cap"), ratio * F.col("_cap")).otherwise(r), wall)
    return out.select(*[c for c in df.columns if c not in ("nodes", "walltime_h", "runtime_h")],
                      F.col("_n").cast("int").alias("nodes"), C.size_tier("_n", tiers).alias("size_tier"),
                      wall.alias("walltime_h"), run.alias("runtime_h"), (F.col("_n") != n).alias("resized"))
