"""Pending jobs at instants, their ranking, and budget features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodehours.blocks import (ARRAY_BYTES, ARRAY_ROWS, BLK, DIM_LIMIT, cut_points, index_of, join_on, last_at, numbered, running,
                              shuffled, StepArrays, small_side, step_arrays, stored, with_block)
from nodehours.functions import score as S


Instants = Sequence[float] | DataFrame


def _listed(instants: Instants) -> list[float] | None:
    """The distinct instants in order, if they are a short list; None for a table (t_h) or a long list, which are joined."""
    if isinstance(instants, DataFrame):
        return None
    out = sorted({float(t) for t in instants})
    return out if len(out) <= DIM_LIMIT else None


def _table(jobs: DataFrame, instants: Instants) -> DataFrame:
    rows = instants if isinstance(instants, DataFrame) else jobs.sparkSession.createDataFrame([(float(t),) for t in instants], "t_h double")
    return stored(rows.select(F.col("t_h").cast("double").alias("t_h")).where("t_h IS NOT NULL").distinct())


def _below(df: DataFrame, col: str, ts: list[float], name: str) -> DataFrame:
    """Number of instants strictly before ``col``; all of them when it is NULL."""
    out = index_of("_neg", [-t for t in ts], df.withColumn("_neg", -F.col(col).cast("double")), name)
    return out.withColumn(name, F.when(F.col(col).isNull(), len(ts)).otherwise(F.lit(len(ts)) - F.col(name))).drop("_neg")


def pending_at(jobs: DataFrame, instants: Instants, submit: str = "submit_h", start: str = "start_h") -> DataFrame:
    """One row per (job, instant) with submit <= t < start.

    Both ends are located in the sorted instants by binary search, so a job
    emits only the instants it waits at.  A short list of instants is a literal.
    A table of them (column t_h) is cut into blocks, one array each: a job meets
    the arrays of the blocks its wait covers and takes the part that it covers.
    """
    ts = _listed(instants)
    if ts is None:
        return _pending_in(jobs, _table(jobs, instants), submit, start)
    df = _below(_below(jobs, submit, ts, "_i"), start, ts, "_j").where(F.col("_i") < F.col("_j"))
    arr = F.array(*[F.lit(t) for t in ts]).cast("array<double>")
    return df.select(*jobs.columns, F.explode(F.slice(arr, F.col("_i") + 1, F.col("_j") - F.col("_i"))).alias("t_h"))


def _pending_in(jobs: DataFrame, instants: DataFrame, submit: str, start: str) -> DataFrame:
    cuts = cut_points(instants, "t_h", rows=ARRAY_ROWS)
    arrays = stored(with_block(instants, "t_h", cuts).groupBy(BLK).agg(F.sort_array(F.collect_list("t_h")).alias("_ts")))
    side = F.broadcast(arrays) if (len(cuts.points) + 1) * ARRAY_ROWS * 8 <= ARRAY_BYTES else shuffled(arrays)
    a, b = F.col(submit).cast("double"), F.coalesce(F.col(start).cast("double"), F.lit(float("inf")))
    waits = jobs.withColumns({"_a": a, "_b": b}).where("_a < _b")
    waits = with_block(with_block(waits, "_a", cuts, "_i"), "_b", cuts, "_j")
    met = waits.withColumn("_m", F.explode(F.sequence("_i", "_j"))).join(side, F.col("_m") == F.col(BLK))
    here = F.slice("_ts", last_at(F.col("_ts"), F.col("_a"), strict=True) + 1,
                   F.greatest(last_at(F.col("_ts"), F.col("_b"), strict=True) - last_at(F.col("_ts"), F.col("_a"), strict=True), F.lit(0)))
    return met.select(*[met[c] for c in jobs.columns], F.explode(here).alias("t_h"))


def count_pending_at(jobs: DataFrame, instants: Instants, submit: str = "submit_h", start: str = "start_h",
                     name: str = "n_instants") -> DataFrame:
    """The jobs that wait at any instant, with how many they wait at: the rows of ``pending_at`` counted, never made.

    Both ends of a wait are placed in the numbered instants by binary search, and the places subtracted, so the work
    follows jobs and instants and not their pairs.
    """
    a, b = F.col(submit).cast("double"), F.coalesce(F.col(start).cast("double"), F.lit(float("inf")))
    waits = jobs.withColumns({"_a": a, "_b": b}).where("_a < _b")
    ts = _listed(instants)
    if ts is None:
        steps = step_arrays(numbered(_table(jobs, instants), [], "t_h", name="_n"), "t_h", "_n", before=0)
        for x in ("_a", "_b"):
            side = steps.side(F.col("ts").alias("_ts"), F.col("vs").alias("_vs"))
            met = with_block(waits, x, steps.cuts, "_s").join(side, F.col("_s") == F.col(BLK))
            # the first entry is the step ahead of the block, so some step is before any position
            at = F.get("_vs", F.greatest(last_at(F.col("_ts"), F.col(x), strict=True), F.lit(1)) - 1)
            waits = met.withColumn(f"{x}_n", at).drop("_s", BLK, "_ts", "_vs")
    else:
        waits = _below(_below(waits, "_a", ts, "_a_n"), "_b", ts, "_b_n")
    n = (F.col("_b_n") - F.col("_a_n")).cast("long")
    return waits.where(n > 0).select(*[F.col(c) for c in jobs.columns], n.alias(name))


def queue_snapshot(jobs: DataFrame, instants: Instants, score: Callable[[Column], Column],
                   cap: int | None = None, submit: str = "submit_h", ident: str = "job_id") -> DataFrame:
    """Pending jobs scored and ranked per instant (score descending, submit, id).

    With ``cap`` only the first ranks are kept and Spark limits each task before
    the shuffle; without it ranks are built from score blocks.
    """
    p = pending_at(jobs, instants, submit)
    p = p.withColumn("score", score(S.eligible(F.col("t_h"), submit)))
    if cap is None:
        return numbered(p, ["t_h"], "score", [submit, ident], "rank", ascending=False)
    w = Window.partitionBy("t_h").orderBy(F.col("score").desc(), submit, ident)
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def topk_union(jobs: DataFrame, instants: Instants, score: Callable[[Column], Column], k: int,
               submit: str = "submit_h", ident: str = "job_id") -> DataFrame:
    """Per instant the top k by score, then the k smallest by size not among them."""
    p = pending_at(jobs, instants, submit)
    p = p.withColumn("score", score(S.eligible(F.col("t_h"), submit)))
    by_score = Window.partitionBy("t_h").orderBy(F.col("score").desc(), submit, ident)
    by_size = Window.partitionBy("t_h").orderBy("nodes", submit, ident)
    # two group-limited ranks; each keeps k rows per instant and task before its shuffle
    top = p.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).withColumn("pick", F.lit("score"))
    small = p.withColumn("rank", F.row_number().over(by_size)).where(F.col("rank") <= k).withColumn("pick", F.lit("size"))
    return top.unionByName(join_on(small, top.select("t_h", ident), ["t_h", ident], "left_anti"))


def delivered_at(jobs: DataFrame, keys: Sequence[str], instants: Instants, start: str = "start_h",
                 entities: DataFrame | None = None) -> DataFrame:
    """Node-hours credited in full at start, per key and instant (start <= t).

    A job is credited to the first instant at or after its start, found by binary
    search, and summed there on the map side; running sums over the instants of a
    key follow, in blocks where the instants are a table (column t_h).
    """
    ts, keys = _listed(instants), list(keys)
    df = jobs.where(F.col(start).isNotNull())
    ids = (entities if entities is not None else jobs).select(*keys).distinct()
    spent = F.sum(F.col("nodes") * F.col("runtime_h")).alias("_nh")
    if ts is None:
        numbers = stored(numbered(_table(jobs, instants), [], "t_h", name="_n"))
        steps = step_arrays(numbers, "t_h", "_n", before=0)
        side = steps.side(F.col("ts").alias("_ts"), F.col("vs").alias("_vs"))
        at = with_block(df.select(*keys, start, "nodes", "runtime_h"), start, steps.cuts, "_s").join(side, F.col("_s") == F.col(BLK))
        per = at.withColumn("_i", F.get("_vs", last_at(F.col("_ts"), F.col(start).cast("double"), strict=True) - 1) + 1).groupBy(*keys, "_i").agg(spent)
        full = join_on(_each(ids, steps), per, [*keys, "_i"], "left").fillna(0.0, ["_nh"])
        return running(full, keys, "t_h", {"delivered_nh": ("sum", "_nh")}).select(*keys, "t_h", "delivered_nh")
    df = _below(df, start, ts, "_i").where(F.col("_i") < len(ts))
    per = df.groupBy(*keys, "_i").agg(spent)
    pts = ids.select(*keys, F.posexplode(F.array(*[F.lit(t) for t in ts]).cast("array<double>")).alias("_i", "t_h"))
    full = join_on(pts, per, [*keys, "_i"], "left")
    # the number of instants per key is bounded, so this window is too
    upto = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return full.select(*keys, "t_h", F.coalesce(F.sum("_nh").over(upto), F.lit(0.0)).alias("delivered_nh"))


def _each(ids: DataFrame, steps: StepArrays) -> DataFrame:
    """Every entity at every instant, which is the report asked for: entities meet the arrays block by block."""
    blocks = ids.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(steps.blocks - 1))))
    rows = blocks.join(steps.side("ts", "vs"), F.col("_m") == F.col(BLK))
    own = F.explode(F.slice(F.arrays_zip("ts", "vs"), F.lit(2), F.size("ts"))).alias("x")  # without the step before the block
    return rows.select(*ids.columns, own).select(*ids.columns, F.col("x.vs").alias("_i"), F.col("x.ts").alias("t_h"))


def budget_features(jobs: DataFrame, budgets: DataFrame, entity: str, instants: Instants,
                    strength: float = 6.0) -> DataFrame:
    """Per entity and instant: pro-rated budget, ratio, damping, delivered share, over-ceiling flag.

    ``budgets`` holds entity, budget_nh and optionally ceiling_nh (NULL: no hard ceiling).
    """
    d = delivered_at(jobs, [entity], instants, entities=budgets)
    totals = d.groupBy("t_h").agg(F.sum("delivered_nh").alias("_total"))
    d = join_on(join_on(d, budgets, [entity], "left"), totals, ["t_h"])
    pro = S.prorated(F.col("budget_nh"), F.col("t_h"))
    ratio = F.when(pro > 0, F.col("delivered_nh") / pro).otherwise(0.0)
    over = F.col("delivered_nh") > F.col("ceiling_nh") if "ceiling_nh" in budgets.columns else F.lit(None).cast("boolean")
    share = F.when(F.col("_total") > 0, F.col("delivered_nh") / F.col("_total")).otherwise(0.0)
    return d.select(entity, "t_h", "delivered_nh", pro.alias("prorated_nh"), ratio.alias("budget_ratio"),
                    S.damping(ratio, strength).alias("budget_damp"), share.alias("delivered_share"),
                    F.coalesce(over, F.lit(False)).alias("over_ceiling"))


def over_ceiling(pending: DataFrame, features: DataFrame, entity: str, nodes: str = "nodes", walltime: str = "walltime_h",
                 name: str = "over_ceiling") -> DataFrame:
    """Whether starting a waiting job could pass its entity's hard ceiling: delivered so far plus its whole request.

    ``features`` holds entity, t_h, delivered_nh and ceiling_nh, ``pending`` the same entity and t_h per job. Without a
    ceiling nothing is over it.
    """
    side = features.select(entity, "t_h", F.col("delivered_nh").alias("_d"), F.col("ceiling_nh").alias("_c"))
    out = join_on(pending, small_side(side), [entity, "t_h"], "left")
    over = F.coalesce("_d", F.lit(0.0)) + F.col(nodes) * F.col(walltime) > F.col("_c")
    return out.withColumn(name, F.coalesce(over, F.lit(False))).drop("_d", "_c")
