"""The three studies end to end: extract a trace, compare waits over a window, reduce a scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodehours.blocks import stored
from nodehours.operators import experiments as E
from nodehours.operators import series as T
from nodehours.operators import stats as A
from nodehours.sources import tables as B
from nodehours.sources import trace as S


def extract_trace(spark: SparkSession, landing: Mapping[str, DataFrame], out: str) -> dict[str, str]:
    """Landing tables to the four typed parquet tables; each is one projection stage without a shuffle.

    Jobs are partitioned by submission month, so a window study reads its months only.
    """
    typed = {"jobs": S.jobs_from_raw, "reservations": S.reservations_from_raw, "queues": S.queues_from_raw,
             "node_availability": S.snapshots_from_raw}
    paths = {}
    for name, raw in landing.items():
        df, part = typed[name](raw), []
        if name == "jobs":
            df, part = df.withColumn("submit_month", F.date_format("submit_time", "yyyy-MM")), ["submit_month"]
        paths[name] = B.write_table(df, f"{out}/{name}.parquet", partition_by=part)
    return paths


def compare_window(jobs: DataFrame, t0: float, t1: float, other_wait: str, queues: Sequence[str], warmup_h: float = 72.0,
                   cooldown_h: float = 48.0, **population) -> tuple[DataFrame, DataFrame]:
    """Population, comparison window, per-queue comparison table and fit summary for one second wait column.

    Jobs without a second wait count at their lower bound, horizon minus submission.
    """
    pop = T.population(jobs, t0, t1, **population)
    horizon = F.lit(float(t1 - t0))
    pop = pop.withColumns({"sim_censored": F.col(other_wait).isNull(),
                           "sim_wait_lb_h": F.coalesce(F.col(other_wait), horizon - F.col("qtime_h"))})
    table = A.compare_table(A.comparison_window(pop, warmup_h, t1 - t0 - cooldown_h), queues)
    return table, A.fit_summary(table, queues)


def reduce_scan(results: DataFrame, objective: str, params: Sequence[str], metrics: Sequence[str], top: int = 8,
                n_seeds: int = 40, maximize: bool = True) -> dict[str, DataFrame]:
    """Per-configuration statistics, main effects, sensitivity ranking and the refinement set of a scan."""
    long = stored(E.mc_summary(results, params, metrics))
    return {"stats": long, "main_effects": {p: E.main_effect(long, p, objective) for p in params},
            "sensitivity": E.sensitivity(long, params, objective), "top": E.top_configs(long, objective, top, not maximize),
            "refine": E.refine(results, objective, top, n_seeds, params, maximize)}
