"""Exact distribution statistics whose groups may be arbitrarily large.

Quantiles and KS distances are found in two steps: a histogram over equal-depth
blocks (summed on the map side, so almost nothing is shuffled), then ranking of
only those blocks that can hold the answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodehours.blocks import BLK, Cuts, cut_points, join_on, numbered, running, small_side, stored, with_block


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
              cuts: Cuts | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles of ``value`` per group.

    ``probs`` maps output columns to probabilities.  Groups without a non-null
    value give no row.
    """
    return _quantiles(df, list(keys), [(F.col(value), probs)], cuts)


def summarize(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column],
              quants: Sequence[tuple[Column, dict[str, float]]], cuts: Cuts | None = None) -> DataFrame:
    """Ordinary aggregates and exact quantiles per group, one row per group of ``df``.

    The quantiles of all columns are found together.  A group without values has
    NULL quantiles.
    """
    keys = list(keys)
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    q = _quantiles(df, keys, quants, cuts)  # one row per group
    names = [n for _, probs in quants for n in probs]
    if not keys:
        q = stored(q)
        return out.select(*aggs, *[q.select(n).scalar().alias(n) for n in names])
    return join_on(out, q, keys, "left").select(*keys, *aggs, *names)


def _quantiles(df: DataFrame, keys: list[str], quants: Sequence[tuple[Column, dict[str, float]]], cuts: Cuts | None = None) -> DataFrame:
    """Exact quantiles of any number of columns in three passes over the input.

    Each row is one (number of the column, value) per column.  One sketch over all
    of them cuts the values into blocks; one histogram finds the blocks with the
    wanted ranks; one pass counts the distinct values of those blocks alone.
    """
    sample = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), c.cast("double").alias("v")) for i, (c, _) in enumerate(quants)]),
                      lambda x: x["v"].isNotNull())
    data = df.select(*keys, F.explode(sample).alias("_s")).select(*keys, F.col("_s.i").alias("_i"), F.col("_s.v").alias("_v"))
    b = with_block(data, "_v", cut_points(data, "_v") if cuts is None else cuts)
    group = Window.partitionBy(*keys, "_i")
    hist = b.groupBy(*keys, "_i", BLK).agg(F.count(F.lit(1)).alias("_n"))
    hist = (hist.withColumn("_hi", F.sum("_n").over(group.orderBy(BLK)))
            .withColumn("_lo", F.col("_hi") - F.col("_n"))
            .withColumn("_total", F.sum("_n").over(group)))
    wanted = []
    names = [(i, n, p) for i, (_, probs) in enumerate(quants) for n, p in probs.items()]
    for k, (i, _, p) in enumerate(names):
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        frac = pos - F.floor(pos)
        wanted += [F.struct(F.lit(i).alias("i"), F.lit(k).alias("q"), F.floor(pos).cast("long").alias("rank"), (1 - frac).alias("w")),
                   F.struct(F.lit(i).alias("i"), F.lit(k).alias("q"), F.ceil(pos).cast("long").alias("rank"), frac.alias("w"))]
    mine = F.filter(F.array(*wanted), lambda x: (x["i"] == F.col("_i")) & (x["rank"] >= F.col("_lo")) & (x["rank"] < F.col("_hi")))
    # keys x blocks rows, stored so that their size is known; the facts are not
    picks = small_side(stored(hist.select(*keys, "_i", BLK, F.transform(mine, lambda x: F.struct(
        x["q"].alias("q"), x["w"].alias("w"), (x["rank"] - F.col("_lo")).alias("r"))).alias("_want")).where(F.size("_want") > 0)))
    at = [*keys, "_i", BLK]
    cand = join_on(b, picks.select(*at), at, "left_semi").groupBy(*at, "_v").agg(F.count(F.lit(1)).alias("_c"))
    cand = cand.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*at).orderBy("_v")))
    hit = join_on(cand, picks, at).select(*keys, "_v", F.explode(F.filter("_want", lambda x: (
        x["r"] >= F.col("_upto") - F.col("_c")) & (x["r"] < F.col("_upto")))).alias("_h"))
    return hit.groupBy(*keys).agg(*[F.sum(F.when(F.col("_h.q") == k, F.col("_v") * F.col("_h.w"))).alias(n) for k, (_, n, _) in enumerate(names)])


def ks_distance(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), cuts: Cuts | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of columns ``a`` and ``b`` per group.

    The block histogram bounds |Fa - Fb| inside each block, so only blocks that
    could exceed the largest distance already seen at block ends are ranked.
    """
    keys = list(keys)
    sample = F.explode(F.array(
        F.struct(F.col(a).cast("double").alias("v"), F.lit(1).alias("na"), F.lit(0).alias("nb")),
        F.struct(F.col(b).cast("double").alias("v"), F.lit(0).alias("na"), F.lit(1).alias("nb"))))
    vals = df.select(*keys, sample.alias("s")).select(*keys, "s.*").where(F.col("v").isNotNull())
    if not keys:  # a key of the rows themselves, so that blocks are joined by equality
        return _ks(vals.withColumn("_all", F.least("na", F.lit(0))), ["_all"], cuts).drop("_all")
    return _ks(vals, keys, cuts)


def _ks(vals: DataFrame, keys: list[str], cuts: Cuts | None) -> DataFrame:
    blocked = with_block(vals, "v", cut_points(vals, "v") if cuts is None else cuts)
    group = Window.partitionBy(*keys)
    hist = blocked.groupBy(*keys, BLK).agg(F.sum("na").alias("ha"), F.sum("nb").alias("hb"))
    upto = group.orderBy(BLK)
    hist = (hist.withColumn("a1", F.sum("ha").over(upto)).withColumn("b1", F.sum("hb").over(upto))
            .withColumn("ta", F.sum("ha").over(group)).withColumn("tb", F.sum("hb").over(group))
            .where((F.col("ta") > 0) & (F.col("tb") > 0)))
    fa1, fb1 = F.col("a1") / F.col("ta"), F.col("b1") / F.col("tb")
    fa0 = (F.col("a1") - F.col("ha")) / F.col("ta")
    fb0 = (F.col("b1") - F.col("hb")) / F.col("tb")
    hist = (hist.withColumn("_ub", F.greatest(fa1 - fb0, fb1 - fa0))
            .withColumn("_ends", F.max(F.abs(fa1 - fb1)).over(group)))
    hist = stored(hist)  # keys x blocks rows, read three times; the facts are not
    open_blocks = hist.where(F.col("_ub") >= F.col("_ends")).select(
        *keys, BLK, (F.col("a1") - F.col("ha")).alias("_a0"), (F.col("b1") - F.col("hb")).alias("_b0"), "ta", "tb")
    distinct = (join_on(blocked, small_side(open_blocks.select(*keys, BLK)), [*keys, BLK], "left_semi")
                .groupBy(*keys, BLK, "v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")))
    inside = Window.partitionBy(*keys, BLK).orderBy("v")
    steps = join_on(distinct.withColumn("ca", F.sum("na").over(inside)).withColumn("cb", F.sum("nb").over(inside)),
                    small_side(open_blocks), [*keys, BLK])
    gap = F.abs((F.col("_a0") + F.col("ca")) / F.col("ta") - (F.col("_b0") + F.col("cb")) / F.col("tb"))
    best = steps.select(*keys, gap.alias("ks")).unionByName(hist.select(*keys, F.col("_ends").alias("ks")))
    return best.groupBy(*keys).agg(F.max("ks").alias("ks"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """Average rank of each distinct value per group, given row weights."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.sum(weight).alias("_c"))
    upto = running(counts, keys, value, {"_upto": ("sum", "_c")})
    return upto.select(*keys, value, (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2).alias(name))


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman rank correlation with average ranks for ties; NULL below three pairs.

    Equal pairs are counted first, so a hot value such as "no wait" is one row
    per partner value before anything is ranked or joined.
    """
    keys = list(keys)
    pairs = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
             .groupBy(*keys, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
             .agg(F.count(F.lit(1)).alias("_c0")))
    ranked = join_on(pairs, average_ranks(pairs, keys, "_a", "_c0", "_ra"), [*keys, "_a"])
    ranked = join_on(ranked, average_ranks(pairs, keys, "_b", "_c0", "_rb"), [*keys, "_b"])
    c, x, y = F.col("_c0"), F.col("_ra"), F.col("_rb")
    s = ranked.groupBy(*keys).agg(
        F.sum(c).alias("n"), F.sum(c * x).alias("sx"), F.sum(c * y).alias("sy"),
        F.sum(c * x * x).alias("sxx"), F.sum(c * y * y).alias("syy"), F.sum(c * x * y).alias("sxy"))
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    var = (F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n)
    rho = F.when((n > 2) & (var > 0), cov / F.sqrt(var))
    return s.select(*keys, rho.alias("spearman"))


def ecdf(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Empirical CDF: one row per distinct value with its cumulative share."""
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    upto = running(counts, keys, value, {"_upto": ("sum", "n")})
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    if keys:
        out = join_on(upto, totals, keys)
        share = F.col("_upto") / F.col("_total")
    else:
        out, share = upto, F.col("_upto") / totals.scalar()
    return out.select(*keys, value, "n", share.alias("cdf"))


def concentration(df: DataFrame, keys: Sequence[str], entity: str, value: str) -> DataFrame:
    """Cumulative share of ``value`` by descending rank of the entity within its group."""
    keys = list(keys)
    per = df.groupBy(*keys, entity).agg(F.sum(value).alias(value))
    per = stored(per)
    ranked = numbered(per, keys, value, [entity], "rank", ascending=False)
    upto = running(ranked, keys, "rank", {"_upto": ("sum", value)})
    totals = per.groupBy(*keys).agg(F.sum(value).alias("_total"))
    out = join_on(upto, totals, keys) if keys else upto.withColumn("_total", totals.scalar())
    return out.select(*keys, entity, "rank", value, F.try_divide("_upto", "_total").alias("cum_share"))


def hist(df: DataFrame, value: Column, width: float, lo: float, hi: float, keys: Sequence[str] = ()) -> DataFrame:
    """Fixed-width histogram of ``value`` clipped to [lo, hi]; the last edge is inclusive."""
    keys = list(keys)
    last = round((hi - lo) / width) - 1
    x = F.least(F.greatest(value, F.lit(float(lo))), F.lit(float(hi)))
    b = F.least(F.floor((x - F.lit(float(lo))) / F.lit(float(width))), F.lit(last)).cast("long")
    return (df.where(value.isNotNull()).groupBy(*keys, (F.lit(float(lo)) + b * F.lit(float(width))).alias("bin_lo"))
            .agg(F.count(F.lit(1)).alias("n")))
