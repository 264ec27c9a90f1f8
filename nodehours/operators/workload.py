"""Workload profile: seasonal demand, cells, projects, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodehours.blocks import join_on, small_side
from nodehours.functions import clean as C
from nodehours.functions.constants import YEAR_H


def with_offset(df: DataFrame, programs: DataFrame, month: str = "cal_month") -> DataFrame:
    """Month offset since the allocation year of each row's program started."""
    dim = programs.select("program", "start_month")
    out = join_on(df, small_side(dim), ["program"])
    return out.withColumn("alloc_off", C.alloc_offset(month, F.col("start_month"))).drop("start_month")


def burn_curve(df: DataFrame, programs: DataFrame, min_coverage: float = 0.40, min_mult: float = 0.40) -> DataFrame:
    """Seasonal multiplier per (program, month offset), mean 1 over the months present.

    Months with too few jobs or too small a multiplier become the mean of
    their circular neighbours, one after the other, so a later low month sees
    neighbours already replaced; then the present months are renormalised.
    A listed program without jobs has twelve ones.
    """
    per = (with_offset(df, programs).groupBy("program", "alloc_off")
           .agg(F.sum(F.col("nodes") * F.col("runtime_h")).alias("nh"), F.count(F.lit(1)).alias("n")))
    # at most twelve entries per program from here on
    year = per.groupBy("program").agg(F.map_from_entries(F.collect_list(F.struct("alloc_off", F.struct("nh", "n")))).alias("_m"))
    year = join_on(programs.select("program").distinct(), year, ["program"], "left")
    slots = F.sequence(F.lit(0), F.lit(11))

    def slot(field: str):
        return F.transform(slots, lambda i: F.try_element_at(F.col("_m"), i)[field])

    year = year.withColumn("_nh", slot("nh")).withColumn("_n", F.transform(slot("n"), lambda x: F.coalesce(x, F.lit(0))))

    def mean_of(arr: Column) -> Column:
        kept = F.filter(arr, lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept))

    def only_present(arr: Column) -> Column:
        return F.zip_with(arr, F.col("_n"), lambda m, n: F.when(n > 0, m))

    year = year.withColumn("_avg", mean_of(F.col("_nh")))
    first = F.when(F.col("_avg") > 0, F.transform("_nh", lambda x: F.when(x.isNull(), 1.0).otherwise(x / F.col("_avg"))))
    year = year.withColumn("_raw", F.coalesce(first, F.transform(slots, lambda i: F.lit(1.0))))
    counts = F.array_sort(F.filter("_n", lambda x: x > 0))
    year = year.withColumn("_sorted", counts).withColumn("_k", F.size("_sorted"))
    mid = (F.get("_sorted", F.floor((F.col("_k") - 1) / 2).cast("int")) + F.get("_sorted", F.floor(F.col("_k") / 2).cast("int"))) / 2.0
    year = year.withColumn("_median", mid)
    low = F.zip_with("_n", "_raw", lambda n, m: (
        (F.lit(min_coverage > 0) & (n < F.col("_median") * min_coverage)) | (F.lit(min_mult > 0) & (n > 0) & (m < min_mult))))
    smooths = (F.col("_k") > 2) & (F.col("_avg") > 0) & F.lit(min_coverage > 0 or min_mult > 0)
    year = year.withColumn("_low", F.transform(low, lambda x: x & smooths))

    def replace(acc: Column, o: Column) -> Column:
        before, after = acc[F.pmod(o - 1, F.lit(12))], acc[F.pmod(o + 1, F.lit(12))]
        return F.when(F.col("_low")[o], F.transform(acc, lambda x, i: F.when(i == o, (before + after) / 2.0).otherwise(x))).otherwise(acc)

    year = year.withColumn("_smooth", F.aggregate(slots, F.col("_raw"), replace))
    year = year.withColumn("_norm", mean_of(only_present(F.col("_smooth"))))
    final = F.transform("_smooth", lambda x, i: F.when(smooths & (F.col("_n")[i] > 0) & (F.col("_norm") > 0), x / F.col("_norm")).otherwise(x))
    rows = year.select("program", F.posexplode(final).alias("alloc_off", "mult"))
    rows = join_on(rows, small_side(programs.select("program", "start_month")), ["program"])
    month = (F.pmod(F.col("alloc_off") + F.col("start_month") - 1, F.lit(12)) + 1).cast("int")
    return rows.select("program", "alloc_off", month.alias("cal_month"), "mult")


def cell_profile(df: DataFrame, programs: DataFrame, min_rows: int = 20) -> DataFrame:
    """Rows per (program, month offset, size tier); thin cells are flagged."""
    out = with_offset(df, programs).groupBy("program", "alloc_off", "size_tier").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("thin", F.col("n") < min_rows)


def span_hours(df: DataFrame, ts: str = "submit_time") -> Column:
    """Hours between the first and last submission, as a scalar."""
    return df.agg(C.hours_since(F.max(ts), F.min(ts))).scalar()


def base_rates(df: DataFrame, span_h: Column, load: float = 1.0, key: str = "program") -> DataFrame:
    """Arrivals per hour and program: rows / span x load."""
    rate = F.when(span_h > 0, F.col("n") / span_h).otherwise(1.0) * F.lit(float(load))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, "n", rate.alias("rate_h"))


def project_profile(df: DataFrame, span_h: Column, min_jobs: int = 20, over_allocation: float = 1.15, load: float = 1.0) -> DataFrame:
    """Rate, delivered node-hours and award per project; small projects fold into ``<program>_misc``.

    Projects are totalled first, so the fold works on one row per project.
    """
    per = df.groupBy("program", "project").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("nodes") * F.col("runtime_h")).alias("nh"))
    name = F.when(F.col("n") >= min_jobs, F.col("project")).otherwise(F.concat("program", F.lit("_misc")))
    out = per.groupBy("program", name.alias("project")).agg(F.sum("n").alias("n"), F.sum("nh").alias("delivered_nh"))
    rate = F.when(span_h > 0, F.col("n") / span_h).otherwise(1.0) * F.lit(float(load))
    return out.select("program", "project", "n", rate.alias("rate_h"), "delivered_nh",
                      (F.col("delivered_nh") * over_allocation).alias("award_nh"))


def folded_project(df: DataFrame, min_jobs: int = 20) -> DataFrame:
    """Rows with small projects renamed to ``<program>_misc``."""
    big = df.groupBy("program", "project").agg(F.count(F.lit(1)).alias("_n"))
    out = join_on(df, big, ["program", "project"])
    return out.withColumn("project", F.when(F.col("_n") >= min_jobs, F.col("project")).otherwise(
        F.concat("program", F.lit("_misc")))).drop("_n")


def rate_from_share(draws: DataFrame, share: float, machine_nodes: int, active_frac: float) -> DataFrame:
    """Hourly rate that delivers ``share`` of the machine's year with the drawn jobs, over the active part of the year."""
    mean_nh = F.avg(F.col("nodes") * F.col("walltime_h") * F.col("rt_ratio"))
    target = share * machine_nodes * YEAR_H
    rate = F.lit(target) / F.greatest(mean_nh, F.lit(1e-9)) / F.lit(YEAR_H * max(active_frac, 1e-9))
    return draws.agg(mean_nh.alias("mean_nh"), rate.alias("rate_h"))
