"""Questions a trace is asked again and again: demand over capacity, avoidable waits, peaks, score regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodehours.blocks import BLK, GRID_BLOCK, StepArrays, bin_sums, join_on, last_at, step_arrays, stored, with_block
from nodehours.operators.lookups import cap_audit, step_levels
from nodehours.operators.quantiles import summarize


def share_over_capacity(jobs: DataFrame, capacity: float, t0: float, t1: float, dt: float = 0.25) -> DataFrame:
    """Share of the window in which mean demand per bin exceeds the capacity, time-weighted, and its peak."""
    b = bin_sums(jobs, "start_h", "end_h", "nodes", t0, t1, dt)
    level = F.col("total") / F.col("width_h")
    return b.agg((F.sum(F.when(level > capacity, F.col("width_h")).otherwise(0.0)) / F.sum("width_h")).alias("share_over"),
                 F.max(level).alias("peak"))


def range_max(df: DataFrame, cells: DataFrame, lo: Column, hi: Column, bins: int, value: str, name: str) -> DataFrame:
    """Maximum of a grid column over the cell range [lo, hi] of each row; NULL for an empty range.

    Each cell carries the maxima over the 2^k cells from it on.  Two such
    entries cover any range, so a row does two equality lookups into a table of
    grid size, whatever the length of its range.
    """
    top = max(1, bins.bit_length())
    t = cells.select(F.col("bin").cast("long").alias("bin"), F.col(value).cast("double").alias("m0"))
    plain = bins <= GRID_BLOCK
    for k in range(1, top):
        half = 1 << (k - 1)
        if plain:  # the grid length bounds this window
            nxt = F.lead(f"m{k - 1}", half).over(Window.orderBy("bin"))
            t = t.withColumn(f"m{k}", F.greatest(F.col(f"m{k - 1}"), nxt))
        else:
            t = stored(t)
            ahead = t.select((F.col("bin") - half).alias("bin"), F.col(f"m{k - 1}").alias("_nxt"))
            t = join_on(t, ahead, ["bin"], "left").withColumn(f"m{k}", F.greatest(f"m{k - 1}", "_nxt")).drop("_nxt")
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("_lvl"), F.col(f"m{k}").alias("m")) for k in range(top)]))
    table = stored(t.select("bin", rows.alias("r")).select("bin", "r.*"))
    q = df.withColumn("_lo", lo.cast("long")).withColumn("_hi", hi.cast("long"))
    span = F.col("_hi") - F.col("_lo") + 1
    q = q.withColumn("_lvl", F.when(span > 0, F.floor(F.log2(span.cast("double")))).cast("int"))
    q = q.withColumn("_b", F.col("_hi") - F.pow(F.lit(2.0), F.col("_lvl")).cast("long") + 1)
    q = join_on(q, table.select(F.col("bin").alias("_lo"), "_lvl", F.col("m").alias("_x")), ["_lo", "_lvl"], "left")
    q = join_on(q, table.select(F.col("bin").alias("_b"), "_lvl", F.col("m").alias("_y")), ["_b", "_lvl"], "left")
    return q.select(*df.columns, F.greatest("_x", "_y").alias(name))


def free_while_waiting(jobs: DataFrame, capacity: float, submit: str = "submit_h", start: str = "start_h", end: str = "end_h",
                       nodes: str = "nodes", name: str = "most_free") -> DataFrame:
    """Most nodes free at any instant of [submit, start), as the jobs themselves occupy them; NULL without a wait.

    Starts and ends are netted per instant into a step series, held as one array per block together with the maxima of
    its leading and trailing parts.  A wait is the trailing part of its first block, the leading part of its last one,
    and the whole blocks between, whose maximum two rows of a sparse table over blocks give; a wait inside one block is
    a slice of its array.  So every opening counts, however short, and no wait is walked through.
    """
    levels = step_levels(jobs, start, end, nodes, name="_busy").select("t_h", (F.lit(float(capacity)) - F.col("_busy")).alias("free"))
    steps = step_arrays(levels, "t_h", "free", before=float(capacity))
    # maxima of the parts run along a block, once each way: a part looked at by itself would walk the block for each of its steps
    each = steps.table.select(BLK, F.posexplode(F.arrays_zip("ts", "vs"))).select(BLK, "pos", "col.ts", "col.vs")
    upto = lambda by: F.max("vs").over(Window.partitionBy(BLK).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("lead", upto(F.col("pos").asc())).withColumn("trail", upto(F.col("pos").desc()))
    whole = each.groupBy(BLK).agg(F.sort_array(F.collect_list(F.struct("pos", "ts", "vs", "lead", "trail"))).alias("s"))
    table = StepArrays(stored(whole.select(BLK, *[F.col(f"s.{c}").alias(c) for c in ("ts", "vs", "lead", "trail")])), steps.cuts, 2 * steps.blocks)
    waits = jobs.where(F.col(submit) < F.col(start)).withColumns({"_a": F.col(submit).cast("double"), "_b": F.col(start).cast("double")})
    waits = with_block(with_block(waits, "_a", steps.cuts, "_i"), "_b", steps.cuts, "_j")
    a, b = table.table.columns, "_b"
    first = table.side(*[F.col(c).alias(f"{c}0") for c in a if c != BLK]).withColumnRenamed(BLK, "_i")
    last = table.side(F.col("ts").alias("ts1"), F.col("lead").alias("lead1")).withColumnRenamed(BLK, "_j")
    waits = waits.join(first, "_i")
    at = last_at(F.col("ts0"), F.col("_a")) - 1  # the step that holds at submission
    inside = F.array_max(F.slice("vs0", at + 1, F.greatest(last_at(F.col("ts0"), F.col(b), strict=True) - at, F.lit(1))))
    waits = waits.withColumn("_head", F.when(F.col("_i") == F.col("_j"), inside).otherwise(F.get("trail0", at))).drop("ts0", "vs0", "lead0", "trail0")
    # what the last block inherits belongs to blocks that are covered anyway
    waits = waits.join(last, "_j").withColumn("_tail", F.when(F.col("_i") < F.col("_j"), F.get("lead1", last_at(F.col("ts1"), F.col(b), strict=True) - 1)))
    cells = steps.table.select(F.col(BLK).alias("bin"), F.array_max("vs").alias("most"))
    waits = range_max(waits.drop("ts1", "lead1"), cells, F.col("_i") + 1, F.col("_j") - 1, steps.blocks, "most", "_mid")
    best = F.greatest("_head", "_tail", "_mid").alias(name)
    none = jobs.where(~F.coalesce(F.col(submit) < F.col(start), F.lit(False))).withColumn(name, F.lit(None).cast("double"))
    return waits.select(*jobs.columns, best).unionByName(none)


def waited_despite_free(jobs: DataFrame, capacity: float, t1: float, min_wait: float = 1.0, keys: Sequence[str] = ("queue",)) -> DataFrame:
    """Share of jobs started by ``t1`` that waited longer than ``min_wait`` although enough nodes were free at some time of the wait."""
    started = F.col("start_h").isNotNull() & (F.col("start_h") <= t1)
    hit = F.coalesce((F.col("start_h") - F.col("submit_h") > min_wait) & (F.col("most_free") >= F.col("nodes")), F.lit(False))
    got = free_while_waiting(jobs.select(*keys, "submit_h", "start_h", "end_h", "nodes"), capacity).where(started)
    return got.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_avoidable"),
                                  (F.count_if(hit) / F.count(F.lit(1))).alias("share"))


def peak_concurrency(jobs: DataFrame, queues: DataFrame) -> DataFrame:
    """Peak running jobs per (queue, project) and peak nodes per queue."""
    return cap_audit(jobs, queues, limits={"project": "max_run_per_project", "queue": "max_nodes_total"}).select(
        "scope", "queue", "entity", "peak")


def eligible_wait(jobs: DataFrame, keys: Sequence[str] = ("queue",)) -> DataFrame:
    """Median wait from submission and from eligibility, and the share of jobs with a dependency."""
    return summarize(jobs, list(keys), {"n": F.count(F.lit(1)), "depend_share": F.avg(F.col("has_depend").cast("double"))},
                     [(F.col("start_h") - F.col("submit_h"), {"wait_p50_h": 0.5}),
                      (F.col("start_h") - F.col("eligible_at_h"), {"eligible_wait_p50_h": 0.5})])


def score_regression(df: DataFrame, target: str, factors: Sequence[str]) -> DataFrame:
    """Log-log least squares of a score on positive factors: one row per term, with R2."""
    cols = [target, *factors]
    pos = F.lit(True)
    for c in cols:
        pos = pos & (F.col(c) > 0)
    logs = df.where(pos).select(*[F.ln(F.col(c).cast("double")).alias(c) for c in cols])
    data = VectorAssembler(inputCols=list(factors), outputCol="_x").transform(logs)
    fit = LinearRegression(featuresCol="_x", labelCol=target, solver="normal").fit(data)
    rows = [("intercept", float(fit.intercept))] + [(f, float(c)) for f, c in zip(factors, fit.coefficients)]
    r2, n, sd = float(fit.summary.r2), int(fit.summary.numInstances), float(fit.summary.rootMeanSquaredError)
    return df.sparkSession.createDataFrame([(t, c, r2, sd, n) for t, c in rows],
                                           "term string, coefficient double, r2 double, rmse double, n long")
