"""Priority scores as column arithmetic; higher runs first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodehours.functions.constants import TOTAL_NODES, YEAR_H


def eligible(now_h: Column | float, since: Column | str = "submit_h") -> Column:
    """Hours accrued at ``now_h``, never negative."""
    now = now_h if isinstance(now_h, Column) else F.lit(float(now_h))
    s = F.col(since) if isinstance(since, str) else since
    return F.greatest(F.lit(0.0), now - s)


def _backfill(e_s: Column) -> Column:
    return F.col("enable_backfill") * F.least(F.col("backfill_max"), e_s / F.col("backfill_factor"))


def score_exact(e_h: Column, total_nodes: int = TOTAL_NODES) -> Column:
    """Quadratic in eligible time, linear in size, walltime clamped to 6..12 h."""
    e_s = e_h * 3600.0
    clamp = F.least(F.greatest(F.col("walltime_h") * 3600.0, F.lit(21600.0)), F.lit(43200.0))
    growth = F.pow(e_s, F.lit(2)) / F.pow(clamp, F.lit(3)) * F.col("project_priority") * F.col("nodes") / total_nodes
    return (F.col("base_score") + F.col("score_boost") + F.col("enable_wfp") * F.col("wfp_factor") * growth
            + _backfill(e_s) + F.col("enable_fifo") * e_s / F.col("fifo_factor"))


def score_fitted(e_h: Column, total_nodes: int = TOTAL_NODES) -> Column:
    """The empirical form: no walltime clamp, FIFO in hours."""
    e_s = e_h * 3600.0
    growth = F.col("project_priority") * F.col("nodes") / total_nodes * F.pow(e_s / 1e4, F.lit(2))
    return (F.col("base_score") + F.col("score_boost") + F.col("enable_wfp") * growth
            + F.col("enable_fifo") * e_h + _backfill(e_s))


def score_fifo(e_h: Column) -> Column:
    return e_h * 3600.0


def score_size_fifo(e_h: Column) -> Column:
    return F.col("nodes") * 1e6 + e_h * 3600.0


# The presets of the ageing family over base, aging_rate, wait,
# nodes, target_share, delivered_share and budget_damp.
AGING_FORMS = {
    "fifo_aging": "base + aging_rate * wait",
    "strong_aging": "base + 3 * aging_rate * wait",
    "small_favoring": "base + aging_rate * wait - 0.002D * nodes",
    "big_favoring": "base + aging_rate * wait + 0.001D * nodes",
    "log_size": "base + aging_rate * wait + 5 * ln(nodes)",
    "fair_share": "base + aging_rate * wait + 30 * (target_share - delivered_share)",
    "budget_aware": "(base + aging_rate * wait) * budget_damp",
    "combined": "base + aging_rate * wait + 20 * (target_share - delivered_share) - 0.5D * ln(nodes)",
}


def score_aging(form: str) -> Column:
    return F.expr(AGING_FORMS[form])


# What a user formula may consist of.
FORMULA_FUNCTIONS = {"least", "greatest", "abs", "exp", "ln", "log", "log1p", "sqrt", "floor", "ceil", "ceiling", "pow", "power", "if"}
FORMULA_NODES = {"Add", "Subtract", "Multiply", "Divide", "IntegralDivide", "Remainder", "UnaryMinus", "UnaryPositive", "LessThan",
                 "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "EqualTo", "Not", "BitwiseAnd", "BitwiseOr", "BitwiseNot", "Literal",
                 "UnresolvedAttribute", "UnresolvedFunction"}


def check_formula(spark: SparkSession, formula: str, allowed: Sequence[str]) -> None:
    """Raise ValueError unless the formula is arithmetic and comparisons over the allowed columns.

    Spark's own parser reads it; every node of the tree must be on the list, names must be plain allowed
    columns, literals numbers, and functions those above, so that no formula reaches subqueries, Java, files or chance.
    """
    try:
        open_ = [spark._jsparkSession.sessionState().sqlParser().parseExpression(formula)]
    except ParseException as e:
        raise ValueError(f"not a formula: {formula}") from e
    while open_:
        node = open_.pop()
        kind = node.getClass().getSimpleName()
        parts = node.nameParts().mkString(".") if kind in ("UnresolvedAttribute", "UnresolvedFunction") else ""
        ok = kind in FORMULA_NODES
        if kind == "UnresolvedAttribute":
            ok = parts in allowed
        elif kind == "UnresolvedFunction":
            ok = parts.lower() in FORMULA_FUNCTIONS or parts in {"+", "-", "*", "/", "%"}
        elif kind == "Literal":
            ok = node.dataType().typeName().split("(")[0] in {"integer", "long", "double", "decimal", "float"}
        if not ok:
            raise ValueError(f"not allowed in a formula: {parts or kind} in {formula}")
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]


def score_expr(df: DataFrame, formula: str, allowed: Sequence[str], name: str = "score") -> DataFrame:
    """A user formula over a declared column list; anything but arithmetic on them is refused (check_formula)."""
    check_formula(df.sparkSession, formula, allowed)
    df.select(*allowed).select(F.expr(formula))
    return df.withColumn(name, F.expr(formula))


def damping(ratio: Column, strength: float) -> Column:
    """1 up to the pro-rated budget, then exponential decay."""
    return F.when(ratio <= 1, F.lit(1.0)).otherwise(F.exp(-F.lit(float(strength)) * (ratio - 1)))


def prorated(budget: Column, t_h: Column | float) -> Column:
    t = t_h if isinstance(t_h, Column) else F.lit(float(t_h))
    return budget * F.least(F.lit(1.0), t / F.lit(YEAR_H))
