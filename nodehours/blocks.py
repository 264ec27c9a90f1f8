"""Building blocks for ordered work that must not end up in one task.

Everything here rests on one idea: cut the ordering axis into blocks, do the
row-level work inside (keys, block), reduce each block to one row, accumulate
over those few rows, and carry the result into the block.  A single hot key is
therefore spread over all blocks, and no task holds more than one block of it.

Blocks come from two places:

* regular grids: the grid index divided by ``GRID_BLOCK`` (bounded by design);
* fact columns: equal-depth cut points from a quantile sketch, one block for
  each ``BLOCK_ROWS`` rows.  The cut points only balance the work; any cut
  points give the same result.

There is one path for every size.  An input of at most ``BLOCK_ROWS`` rows is
one block, which has nothing to carry in.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRID_BLOCK = 4096  # grid cells per block in grid-level running sums
COARSE_CUTS = 1024  # cut points drawn in one pass; more come from a second pass inside these
BLOCK_ROWS = 1_000_000  # rows of a block, about; setting nodehours.blockRows overrides it
ARRAY_ROWS = 256  # steps of a block that is held as one array
ARRAY_BYTES = 32 << 20  # of such arrays that may be broadcast
DIM_LIMIT = 10_000  # rows allowed in a configuration dimension
BLK = "_blk"
_local_scratch: list[str] = []


# --------------------------------------------------------------------------
# small helpers
# --------------------------------------------------------------------------


def block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("nodehours.blockRows", str(BLOCK_ROWS)))


def scratch_dir(spark: SparkSession) -> str:
    """Shared working folder: the one the cluster names; a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="run-"))
    return _local_scratch[0]


def stored(df: DataFrame) -> DataFrame:
    """The same rows read back from a written table: lineage ends there, and executors may be lost."""
    path = f"{scratch_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uniform(*keys: Column | str, seed: int | str | Column) -> Column:
    """Reproducible U[0,1) per row from its key, 52 bits of its hash, independent of partitioning."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    last = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", *[p.cast("string") for p in parts], last)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def dim_rows(dim: DataFrame, cols: Sequence[str], limit: int = DIM_LIMIT) -> list[tuple]:
    """Rows of a configuration dimension for use as literals; its size is checked."""
    rows = dim.select(*cols).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a configuration dimension may hold at most {limit} rows")
    return [tuple(r) for r in rows]


def small_side(dim: DataFrame, limit: int = DIM_LIMIT) -> DataFrame:
    """A dimension marked for broadcast when a count shows it small; otherwise left to a shuffle join."""
    return F.broadcast(dim) if dim.limit(limit + 1).count() <= limit else shuffled(dim)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of an equi-join that is never broadcast: by the size of a well compressed file Spark would take millions of rows for few."""
    return df.hint("merge")


def struct_array(rows: Sequence[tuple], ddl: str) -> Column:
    """Literal array of structs from small configuration rows."""
    types = [f.strip().rsplit(" ", 1) for f in ddl.split(",")]
    if not rows:
        return F.array().cast("array<struct<" + ",".join(f"{n}:{t}" for n, t in types) + ">>")
    return F.array(
        *[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, types)]) for r in rows]
    )


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left copy of the keys."""
    ren = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(ren[f"_r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(ren, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


# --------------------------------------------------------------------------
# equal-depth blocks
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Cuts:
    """Increasing cut points, and blocks that one value fills.

    ``heavy`` maps a block to the number of equal shares its first value alone
    takes; a value that fills several quantiles shows up as a repeated cut.
    """

    points: tuple[float, ...] = ()
    heavy: dict[int, int] = field(default_factory=dict)


def cut_points(df: DataFrame, *cols: str, rows: int | None = None) -> Cuts:
    """Equal-depth cut points over one or more numeric columns, one for each ``rows`` (``BLOCK_ROWS``) values.

    The values are counted first.  Up to ``COARSE_CUTS`` blocks come from one
    sketch per group of input partitions, merged over the bounded set of sketch
    points; if more are needed, each of those is cut again by a sketch of its
    own.  The driver receives the cut points only: 8 bytes for a block.
    """
    if len(cols) == 1:
        vals = df.select(F.col(cols[0]).cast("double").alias("x"))
    else:
        vals = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in cols])).alias("x"))
    vals = vals.where(F.abs("x") < float("inf"))  # no NULL, NaN or infinity: they need no cut point
    blocks = -(-vals.count() // (rows or block_rows(df.sparkSession)))
    if blocks <= 1:
        return Cuts()
    n = min(blocks, COARSE_CUTS)
    probs = [i / n for i in range(1, n)]
    part = vals.groupBy((F.spark_partition_id() % 64).alias("g")).agg(
        F.percentile_approx("x", probs, 4 * n).alias("q"), F.count("x").alias("n"))
    cuts = part.select(F.explode("q").alias("x"), "n").agg(F.percentile("x", probs, F.col("n")).alias("q")).first().q
    if blocks > n:
        k = -(-blocks // n)
        fine = [i / k for i in range(1, k)]
        inner = with_block(vals, "x", Cuts(tuple(sorted(set(cuts))))).groupBy(BLK).agg(F.percentile_approx("x", fine, 4 * k).alias("q"))
        cuts = sorted([*cuts, *(x for r in inner.collect() for x in r.q)])
    times = Counter(cuts)
    points = tuple(sorted(times))
    heavy = {i + 1: times[p] for i, p in enumerate(points) if times[p] > 1}
    return Cuts(points, heavy)


def with_block(df: DataFrame, col: str, cuts: Cuts, name: str = BLK) -> DataFrame:
    """Add the block of ``col``: the number of cut points at or below it.

    NULL is in block -1, before all others, and NaN in the last one, after all
    others, as Spark orders them.  The block is never NULL.
    """
    if not cuts.points:
        return df.withColumn(name, F.lit(0))
    out = Bucketizer(
        splits=[float("-inf"), *cuts.points, float("inf")],
        inputCol="_cut_in",
        outputCol="_cut_out",
        handleInvalid="keep",
    ).transform(df.withColumn("_cut_in", F.coalesce(F.col(col).cast("double"), F.lit(0.0))))
    block = F.when(F.col(col).isNull(), F.lit(-1)).otherwise(F.coalesce(F.col("_cut_out").cast("int"), F.lit(len(cuts.points) + 1)))
    return out.withColumn(name, block).drop("_cut_in", "_cut_out")


def text_position(df: DataFrame, col: str) -> Column:
    """A number that never falls as the text rises: six bytes after the prefix that all values share."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    low, high = (low or "").encode(), (high or "").encode()
    shared = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    six = F.rpad(F.hex(F.expr(f"substring(cast(`{col}` AS binary), {shared + 1}, 6)")), 12, "0")
    return F.conv(six, 16, 10).cast("double")


def index_of(col: str, values: Sequence[float], df: DataFrame, name: str) -> DataFrame:
    """Number of entries of the sorted list ``values`` at or below ``col`` (binary search)."""
    return with_block(df, col, Cuts(tuple(sorted(set(map(float, values))))), name)


# --------------------------------------------------------------------------
# blocked running aggregates
# --------------------------------------------------------------------------


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    aggs: dict[str, tuple[str, str]],
    cuts: Cuts | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Running aggregates in ``order`` per ``keys``; rows with equal order count together.

    ``aggs`` maps an output column to (kind, column) with kind sum, min, max or
    last.  Callers pre-aggregate rows of equal (keys, order).  Pass ``block``
    for a regular grid; otherwise the input is stored once and cut points are
    drawn from ``order``.
    """
    keys = list(keys)
    if block is not None:
        b = df.withColumn(BLK, block)
    else:
        if cuts is None:
            df = stored(df)
            cuts = cut_points(df, order)
        b = with_block(df, order, cuts)
    inside = Window.partitionBy(*keys, BLK).orderBy(order)
    inner = {out: _fold(kind, F.col(col)).over(inside) for out, (kind, col) in aggs.items()}
    if block is None and not cuts.points:
        return b.select(*df.columns, *[e.alias(o) for o, e in inner.items()])
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    fold, carry, merge = {}, {}, {}
    for out, (kind, col) in aggs.items():
        c, k = F.col(col), F.col(f"_c_{out}")
        fold[out] = F.max_by(c, F.when(c.isNotNull(), F.col(order))) if kind == "last" else _fold(kind, c)
        carry[out] = _fold(kind, F.col(out)).over(before)
        merge[out] = {"last": lambda: F.coalesce(inner[out], k), "sum": lambda: inner[out] + F.coalesce(k, F.lit(0)),
                      "min": lambda: F.least(inner[out], k), "max": lambda: F.greatest(inner[out], k)}[kind]()
    totals = b.groupBy(*keys, BLK).agg(*[e.alias(o) for o, e in fold.items()])
    totals = totals.select(*keys, BLK, *[e.alias(f"_c_{o}") for o, e in carry.items()])
    joined = join_on(b, per_block(totals), [*keys, BLK], "left")
    return joined.select(*df.columns, *[e.alias(o) for o, e in merge.items()])


def per_block(totals: DataFrame) -> DataFrame:
    """A table of keys and blocks, stored so that its size is known; broadcast if small, so that facts move once."""
    return small_side(stored(totals))


def _fold(kind: str, c: Column) -> Column:
    if kind == "last":
        return F.last(c, ignorenulls=True)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](c)


def numbered(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[Column | str] = (),
             name: str = "rn", ascending: bool = True, cuts: Cuts | None = None) -> DataFrame:
    """Row number per ``keys`` by ``order`` (then ``ties``) without one task per key.

    ``order`` and ``ties`` may be numbers or texts.  NULLs come first, or last
    when descending.  A value of ``order`` that fills whole blocks by itself
    gets a block of its own, which is cut again by the first tie column.
    """
    keys = list(keys)
    by = F.col(order).asc() if ascending else F.col(order).desc()
    at, df_at = _positioned(df, order, "_at")
    cuts = cut_points(df_at, at) if cuts is None else cuts
    if not cuts.points:
        rn = F.row_number().over(Window.partitionBy(*keys).orderBy(by, *ties))
        return df.select(*df.columns, rn.cast("long").alias(name))
    tie = ties[0] if ties and isinstance(ties[0], str) else None
    if cuts.heavy and tie is not None:
        hot = {cuts.points[i - 1] for i in cuts.heavy}
        points = tuple(sorted({*cuts.points, *(math.nextafter(v, math.inf) for v in hot)}))
        own = [points.index(v) + 1 for v in hot]
        sub, df_at = _positioned(df_at, tie, "_tie")
        b = with_block(df_at, at, Cuts(points))
        b = with_block(b, sub, cut_points(df_at, sub), "_sub").withColumn("_sub", F.when(F.col(BLK).isin(own), F.col("_sub")).otherwise(0))
    else:
        b = with_block(df_at, at, cuts).withColumn("_sub", F.lit(0))
    blk = F.col(BLK) if ascending else -F.col(BLK)
    sizes = b.groupBy(*keys, BLK, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(blk, "_sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, BLK, "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = join_on(b, per_block(sizes), [*keys, BLK, "_sub"], "left")
    rn = F.row_number().over(Window.partitionBy(*keys, BLK, "_sub").orderBy(by, *ties))
    return out.select(*df.columns, (rn + F.col("_off")).alias(name))


def _positioned(df: DataFrame, col: str, name: str) -> tuple[str, DataFrame]:
    """A numeric column that orders as ``col`` does: itself, or for a text its position."""
    if not isinstance(df.schema[col].dataType, T.StringType):
        return col, df
    return name, df.withColumn(name, text_position(df, col))


def following(df: DataFrame, keys: Sequence[str], order: str, cols: dict[str, str], step: int = 1) -> DataFrame:
    """Values of the next row (``step`` -1: previous row) in ``order`` per ``keys``."""
    keys = list(keys)
    cuts = cut_points(df, order)
    if not cuts.points:  # one block has no neighbours
        w = Window.partitionBy(*keys).orderBy(order)
        return df.select(*df.columns, *[F.lead(c, step).over(w).alias(o) for o, c in cols.items()])
    rows = stored(numbered(df, keys, order, name="_rn", cuts=cuts))
    other = rows.select(*keys, (F.col("_rn") - step).alias("_rn"), *[F.col(c).alias(o) for o, c in cols.items()])
    return join_on(rows, other, [*keys, "_rn"], "left").select(*df.columns, *cols)


# --------------------------------------------------------------------------
# as-of lookup
# --------------------------------------------------------------------------


def asof(left: DataFrame, right: DataFrame, on: str, values: Sequence[str],
         keys: Sequence[str] = (), direction: str = "backward", at: str | None = None,
         cuts: Cuts | None = None) -> DataFrame:
    """Attach the latest ``right`` row at or before ``on`` (or the earliest at or after).

    Both sides are cut into the same blocks.  Blocks in which one instant holds
    many left rows are salted, and the right rows of that block are repeated
    for each salt, so a hot instant does not end up in one task.  What a block
    inherits from earlier ones comes from the right side's last row per block.
    ``at`` names an extra output column for the matched position.
    """
    keys, values = list(keys), list(values)
    sign = 1 if direction == "backward" else -1
    hashed = [c for c, t in left.dtypes if not t.startswith("map")]
    lrow = left.select(*keys, (F.col(on).cast("double") * sign).alias("_t"), F.lit(1).alias("_side"),
                       F.struct(*left.columns).alias("_l"),
                       F.pmod(F.xxhash64(*hashed), F.lit(1 << 30)).cast("int").alias("_h"))
    rrow = right.select(*keys, (F.col(on).cast("double") * sign).alias("_t"), F.lit(0).alias("_side"),
                        F.struct(F.col(on).cast("double").alias("_at"), *values).alias("_r"))
    rrow = rrow.where(F.col("_t").isNotNull())
    cuts = cut_points(lrow.select("_t").unionAll(rrow.select("_t")), "_t") if cuts is None else cuts
    lrow, rrow = with_block(lrow, "_t", cuts), with_block(rrow, "_t", cuts)
    part = [*keys, BLK]
    if cuts.heavy:
        pairs = [F.lit(x) for kv in cuts.heavy.items() for x in kv]
        shares = F.coalesce(F.create_map(*pairs)[F.col(BLK)], F.lit(1))
        lrow = lrow.withColumn("_salt", F.pmod("_h", shares))
        rrow = rrow.withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1)))
        part.append("_salt")
    both = lrow.drop("_h").unionByName(rrow, allowMissingColumns=True)
    inside = (Window.partitionBy(*part).orderBy("_t", "_side")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumn("_hit", F.last("_r", ignorenulls=True).over(inside)).where(F.col("_side") == 1)
    if cuts.points:
        ends = _carry(lrow, rrow, keys, len(cuts.points))
        out = join_on(out, per_block(ends), [*keys, BLK], "left").withColumn("_hit", F.coalesce("_hit", "_carry"))
    # a row without a position meets nothing
    hit = F.when(F.col("_t").isNotNull(), F.col("_hit"))
    extra = [hit["_at"].alias(at)] if at else []
    return out.select("_l.*", *extra, *[hit[v].alias(v) for v in values])


def _carry(lrow: DataFrame, rrow: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The last right row of all earlier blocks, for each block; with keys, only where a key has rows on either side."""
    last = rrow.groupBy(*keys, BLK).agg(F.max_by("_r", "_t").alias("_e"))
    if keys:
        wanted = lrow.select(*keys, BLK).distinct().withColumn("_e", F.lit(None).cast(last.schema["_e"].dataType))
        full = last.unionByName(wanted).groupBy(*keys, BLK).agg(F.first("_e", ignorenulls=True).alias("_e"))
    else:
        blocks = rrow.sparkSession.range(top + 1).select(F.col("id").cast("int").alias(BLK))
        full = join_on(blocks, last, [BLK], "left")
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    return full.select(*keys, BLK, F.last("_e", ignorenulls=True).over(before).alias("_carry"))


# --------------------------------------------------------------------------
# step series as one array per block
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class StepArrays:
    """A step series cut into blocks of about ``ARRAY_ROWS`` steps: one row (blk, ts, vs) a block, ts ascending.

    The first entry of a block is the step before it (at minus infinity where there is none), so every instant of
    the block's range finds its step inside.  Rows reach their block by binary search in the cut points.
    """

    table: DataFrame
    cuts: Cuts
    blocks: int

    def side(self, *cols: Column | str) -> DataFrame:
        """The arrays for a join: broadcast while their counted size allows, else left to a shuffle."""
        df = self.table.select(BLK, *cols)
        return F.broadcast(df) if self.blocks * ARRAY_ROWS * 16 <= ARRAY_BYTES else shuffled(df)


def step_arrays(steps: DataFrame, t: str, value: str, before: object = None) -> StepArrays:
    """Cut a step series with distinct instants; ``before`` holds ahead of the first one (None: the first value does)."""
    kind = steps.schema[value].dataType
    rows = stored(steps.select(F.col(t).cast("double").alias("t"), F.col(value).alias("v")).where("t IS NOT NULL"))
    cuts = cut_points(rows, "t", rows=ARRAY_ROWS)
    blocks = len(cuts.points) + 1
    held = with_block(rows, "t", cuts).groupBy(BLK).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s"))
    full = rows.sparkSession.range(blocks).select(F.col("id").cast("int").alias(BLK)).join(held, BLK, "left")
    # one row a block, so this window holds a few hundredths of the steps at most
    last = F.last(F.element_at("s", -1), ignorenulls=True).over(
        Window.partitionBy(F.lit(0)).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1))
    first = F.min("s").over(Window.partitionBy(F.lit(0)))[0]["v"] if before is None else F.lit(before).cast(kind)
    ahead = F.coalesce(last, F.struct(F.lit(float("-inf")).alias("t"), first.alias("v")))
    s = F.concat(F.array(ahead), F.coalesce("s", F.array().cast(full.schema["s"].dataType)))
    table = stored(full.select(BLK, s.alias("s")).select(BLK, F.col("s.t").alias("ts"), F.col("s.v").alias("vs")))
    return StepArrays(table, cuts, blocks)


def last_at(ts: Column, x: Column, strict: bool = False) -> Column:
    """How many entries of an ascending array are at or before ``x`` (``strict``: before it), by binary search."""
    top = 1 << (2 * ARRAY_ROWS).bit_length()
    halves = F.array(*[F.lit(top >> k) for k in range(top.bit_length())])

    def step(p: Column, h: Column) -> Column:
        entry = F.get(ts, p + h - 1)
        inside = F.coalesce(entry < x if strict else entry <= x, F.lit(False))
        return F.when(inside, p + h).otherwise(p)

    # a block of one instant may hold more entries than planned; those beyond the steps of the search are walked
    found = F.aggregate(halves, F.lit(0), step)
    return F.when(F.size(ts) < 2 * top, found).otherwise(F.size(F.filter(ts, lambda e: e < x if strict else e <= x)))


# --------------------------------------------------------------------------
# intervals on a regular grid
# --------------------------------------------------------------------------


def grid(spark: SparkSession, t0: float, t1: float, dt: float, closed: bool = False) -> DataFrame:
    """Bins of width ``dt`` over [t0, t1): columns bin, t_h, width_h; last bin may be partial.

    With ``closed`` the rows are the points t0, t0+dt, .. up to and including t1.
    """
    if closed:
        return spark.range(n_points(t0, t1, dt)).select(
            F.col("id").alias("bin"), (F.lit(float(t0)) + F.col("id") * F.lit(float(dt))).alias("t_h"))
    n = n_bins(t0, t1, dt)
    t = F.lit(float(t0)) + F.col("id") * F.lit(float(dt))
    return spark.range(n).select(
        F.col("id").alias("bin"), t.alias("t_h"),
        (F.least(t + F.lit(float(dt)), F.lit(float(t1))) - t).alias("width_h"))


def n_bins(t0: float, t1: float, dt: float) -> int:
    """Number of bins, the last one possibly partial."""
    full = int((t1 - t0) / dt + 1e-9)
    return full + (1 if t0 + full * dt < t1 - 1e-9 else 0)


def grid_running(df: DataFrame, keys: Sequence[str], aggs: dict[str, tuple[str, str]], bins: int,
                 order: str = "bin") -> DataFrame:
    """Running aggregates over the rows of a grid with ``bins`` points, per key.

    The grid length, which the caller gives, bounds what one task orders;
    longer grids are cut into blocks of ``GRID_BLOCK`` points.
    """
    if bins <= GRID_BLOCK:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.select(*df.columns, *[_fold(k, F.col(c)).over(w).alias(o) for o, (k, c) in aggs.items()])
    return running(df, keys, order, aggs, block=F.floor(F.col(order) / GRID_BLOCK).cast("int"))


def n_points(t0: float, t1: float, dt: float) -> int:
    """Number of points t0, t0+dt, .. up to and including t1."""
    return int((t1 - t0) / dt + 1e-9) + 1


def n_covering(t0: float, t1: float, dt: float) -> int:
    """Number of points t0, t0+dt, .. until the first one at or past t1."""
    return max(0, math.ceil((t1 - t0) / dt - 1e-9)) + 1


def fill_grid(sums: DataFrame, keys: Sequence[str], cols: Sequence[str],
              t0: float, t1: float, dt: float, closed: bool = False) -> DataFrame:
    """All (key, grid row) combinations, absent sums as 0.

    The keys are those present in ``sums``; the output is keys x grid, which is
    the size of the report asked for.
    """
    keys = list(keys)
    points = grid(sums.sparkSession, t0, t1, dt, closed)
    if keys:
        last = (n_points if closed else n_bins)(t0, t1, dt) - 1
        t = F.lit(float(t0)) + F.col("bin") * F.lit(float(dt))
        ids = sums.select(*keys).distinct()
        points = ids.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("bin"))
        points = points.withColumn("t_h", t)
        if not closed:
            points = points.withColumn("width_h", F.least(t + F.lit(float(dt)), F.lit(float(t1))) - t)
    return join_on(points, sums, [*keys, "bin"], "left").fillna(0, list(cols))


def grid_levels(sums: DataFrame, keys: Sequence[str], flows: Sequence[str], levels: dict[str, str],
                t0: float, t1: float, dt: float, closed: bool = False) -> DataFrame:
    """Dense grid rows per key from sparse sums: ``flows`` are 0 where absent, ``levels`` are running sums.

    With keys, each sparse row is repeated up to the next one of its key, so the
    sums are computed once.  One key never has more rows than the grid.
    """
    keys, flows = list(keys), list(flows)
    n = (n_points if closed else n_bins)(t0, t1, dt)
    if not keys or n > GRID_BLOCK:
        full = fill_grid(stored(sums) if keys else sums, keys, [*flows, *levels.values()], t0, t1, dt, closed)
        return grid_running(full, keys, {out: ("sum", c) for out, c in levels.items()}, n)
    w = Window.partitionBy(*keys).orderBy("bin")
    end = F.lit(n).cast("long")
    s = sums.withColumn("bin", F.least("bin", end))
    s = s.select(*keys, "bin", *flows, *[F.sum(c).over(w).cast("double").alias(out) for out, c in levels.items()],
                 F.coalesce(F.lead("bin").over(w), end).alias("_next"), F.lag("bin").over(w).alias("_prev"))

    def row(i: Column, flow, level) -> Column:
        return F.struct(i.alias("bin"), *[flow(f).alias(f) for f in flows], *[level(v).alias(v) for v in levels])

    def zero(_: str) -> Column:
        return F.lit(0.0)

    head = F.when(F.col("_prev").isNull() & (F.col("bin") > 0), F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("bin") - 1), lambda i: row(i, zero, zero)))
    body = F.when(F.col("bin") < end, F.transform(F.sequence(F.col("bin"), F.col("_next") - 1), lambda i: row(
        i, lambda f: F.when(i == F.col("bin"), F.col(f)).otherwise(0.0), F.col)))
    rows = F.explode(F.flatten(F.filter(F.array(head, body), lambda x: x.isNotNull())))
    out = s.select(*keys, rows.alias("_g")).select(*keys, "_g.*")
    t = F.lit(float(t0)) + F.col("bin") * F.lit(float(dt))
    cols = [t.alias("t_h")] if closed else [t.alias("t_h"), (F.least(t + F.lit(float(dt)), F.lit(float(t1))) - t).alias("width_h")]
    return out.select("*", *cols)


def bin_sums(df: DataFrame, start: str, end: str, weight: str, t0: float, t1: float, dt: float,
             keys: Sequence[str] = ()) -> DataFrame:
    """Exact integral of ``weight`` over each grid bin, for intervals [start, end).

    Each interval emits at most four rows: its partial first and last bin and a
    +weight / -weight pair for the full bins between.  The rows are summed per
    bin on the map side, so neither the cost nor the shuffle depends on the
    interval length or on how many intervals share a bin.
    """
    keys = list(keys)
    n = n_bins(t0, t1, dt)
    lo, hi, d = F.lit(float(t0)), F.lit(float(t1)), F.lit(float(dt))
    w = F.col("_w")
    s, e, i, j = F.col("_s"), F.col("_e"), F.col("_i"), F.col("_j")
    # plain comparisons first: they reach the parquet scan and prune partitions
    clipped = (df.where((F.col(start) < hi) & (F.col(end) > lo))
               .select(*keys, F.col(weight).cast("double").alias("_w"),
                       F.least(F.greatest(F.col(start), lo), hi).alias("_s"),
                       F.least(F.greatest(F.col(end), lo), hi).alias("_e"))
               .where(e > s)
               .withColumn("_i", F.least(F.floor((s - lo) / d), F.lit(n - 1)).cast("long"))
               .withColumn("_j", F.least(F.floor((e - lo) / d), F.lit(n - 1)).cast("long")))
    zero = F.lit(0.0)

    def part(b, x, y, level):
        return F.struct(b.alias("bin"), (w * (y - x)).alias("part"), level.alias("step"))

    def edge(k):
        return lo + k * d

    pieces = F.when(i == j, F.array(part(i, s, e, zero))).otherwise(F.array(
        part(i, s, edge(i + 1), zero), part(j, edge(j), e, zero),
        F.struct((i + 1).alias("bin"), zero.alias("part"), w.alias("step")),
        F.struct(j.alias("bin"), zero.alias("part"), (-w).alias("step"))))
    sums = (clipped.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.*")
            .groupBy(*keys, "bin").agg(F.sum("part").alias("part"), F.sum("step").alias("step")))
    full = grid_levels(sums, keys, ["part"], {"level": "step"}, t0, t1, dt)
    return full.select(*keys, "bin", "t_h", "width_h",
                       (F.col("part") + F.col("level") * F.col("width_h")).alias("total"))


def level_on_grid(df: DataFrame, start: str, end: str, weight: str | None, t0: float, t1: float,
                  dt: float, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of ``weight`` over intervals with start <= t < end, at the points t0, t0+dt, .. t1.

    Each interval adds its weight at the first grid point at or after its start
    and removes it at the first grid point at or after its end.
    """
    keys = list(keys)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")

    def first_point(c):
        return F.greatest(F.ceil((c - F.lit(float(t0))) / F.lit(float(dt))), F.lit(0)).cast("long")

    far = F.lit(float(t1)) + F.lit(2.0 * dt)
    ends = F.coalesce(F.col(end), far)
    deltas = (df.where(F.col(start).isNotNull())
              .select(*keys, F.explode(F.array(
                  F.struct(first_point(F.col(start)).alias("bin"), w.alias("step")),
                  F.struct(first_point(F.greatest(ends, F.col(start))).alias("bin"), (-w).alias("step"))
              )).alias("p")).select(*keys, "p.*")
              .groupBy(*keys, "bin").agg(F.sum("step").alias("step")))
    full = grid_levels(deltas, keys, [], {"level": "step"}, t0, t1, dt, closed=True)
    return full.select(*keys, "bin", "t_h", "level")
