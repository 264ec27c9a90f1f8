"""Cleaning and conversion: column functions over raw and typed job rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodehours.blocks import join_on, numbered, per_block, stored
from nodehours.functions.constants import QUEUE_DEFAULTS, RESERVATION_QUEUE, SCORING_DEFAULTS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: Column | str) -> Column:
    """Double, or NULL when the text is not a finite or infinite number."""
    d = _c(x).try_cast("double")
    return F.when(~F.isnan(d), d)


def num_lenient(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number(c) for c in cols})


def hms_hours(x: Column | str, two_part: bool = False) -> Column:
    """``HH:MM:SS`` to hours (hours may exceed 24); with ``two_part`` also ``MM:SS``."""
    parts = F.split(_c(x), ":")
    p = [number(F.get(parts, F.lit(i))) for i in range(3)]
    full = p[0] + p[1] / 60.0 + p[2] / 3600.0
    if not two_part:
        return full
    size = F.size(parts)
    return F.when(size == 3, full).when(size == 2, p[0] / 60.0 + p[1] / 3600.0)


def ts_lenient(x: Column | str) -> Column:
    """ISO text or timestamp to a timestamp without zone, NULL when unparsable; independent of the session zone."""
    return _c(x).try_cast("timestamp_ntz")


# fixed values: English month names, three letters each
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def ts_weekday(x: Column | str) -> Column:
    """``Mon Mar 02 10:11:12 2026``; the weekday name carries no information."""
    pattern = r"^\s*[A-Za-z]{3}\s+([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{1,2}:\d{2}:\d{2})\s+(\d{4})\s*$"

    def part(i: int) -> Column:
        return F.regexp_extract(_c(x), pattern, i)

    at = F.position(part(1), F.lit(MONTHS))
    month = F.when((F.length(part(1)) == 3) & (F.pmod(at, F.lit(3)) == 1), F.floor((at + 2) / 3))
    iso = F.concat(part(4), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit(" "), part(3))
    return iso.try_cast("timestamp_ntz")


def json_fields(df: DataFrame, col: str, plain: Sequence[str] = (), nested: Mapping[str, Sequence[str]] | None = None,
                present: Mapping[str, str] | None = None) -> DataFrame:
    """Extract JSON text fields with one parse: top level, one level down, presence flags."""
    nested, present = nested or {}, present or {}
    top = list(dict.fromkeys([*plain, *present.values()]))
    ddl = ", ".join([f"`{f}` string" for f in top] +
                    [f"`{s}` struct<" + ", ".join(f"`{f}`: string" for f in fs) + ">" for s, fs in nested.items()])
    out = df.withColumn("_j", F.from_json(col, ddl))
    cols = {f: F.col("_j")[f] for f in plain}
    cols |= {f: F.col("_j")[s][f] for s, fs in nested.items() for f in fs}
    cols |= {name: F.col("_j")[f].isNotNull() for name, f in present.items()}
    return out.withColumns(cols).drop("_j")


def parse_limit(x: Column | str, prefix: str) -> Column:
    """Number of the first ``[prefix:NAME=number]`` entry of a limit string."""
    raw = F.regexp_extract(_c(x), r"(?:^|\[)\s*" + prefix + r":[^\]\[=]*=([^\]\[]*)", 1)
    return number(F.nullif(raw, F.lit("")))


def hours_since(ts: Column | str, origin: Column | str) -> Column:
    """Hours from ``origin`` (timestamp text or column) to ``ts``, by wall clock.

    The difference of two zone-free timestamps is an interval that knows no
    daylight saving; its microseconds are exact in a double.
    """
    o = F.lit(origin) if isinstance(origin, str) else origin
    span = _c(ts).cast("timestamp_ntz") - o.cast("timestamp_ntz")
    seconds = span.cast("interval second").cast("decimal(18,6)").cast("double")
    return F.rint(seconds * 1e6) / F.lit(3.6e9)


def wait_hours(queue_s: Column | str, start: Column | str, submit: Column | str) -> Column:
    """Recorded queue seconds as hours, else start minus submit (timestamps)."""
    return F.coalesce(_c(queue_s) / 3600.0, hours_since(start, _c(submit)))


def wait_hours_rel(queue_s: Column | str, start_h: Column | str, submit_h: Column | str) -> Column:
    return F.coalesce(_c(queue_s) / 3600.0, _c(start_h) - _c(submit_h))


def state_counts(df: DataFrame, ts: str = "timestamp", data: str = "snapshot_data") -> DataFrame:
    """Node-state letters per snapshot: E busy, A free, L reserved, everything else down."""
    def count(letter):
        return F.length(data) - F.length(F.replace(data, F.lit(letter), F.lit("")))

    busy, free, resv, n = count("E"), count("A"), count("L"), F.length(data)
    return (df.where((n > 0) & F.col(ts).isNotNull())
            .select(F.col(ts), n.alias("n"), busy.alias("busy_nodes"), free.alias("free_nodes"),
                    resv.alias("resv_nodes"), (busy + free).alias("up_nodes"),
                    (n - busy - free - resv).alias("down_nodes")))


def map_values(x: Column | str, mapping: Mapping[str, str], default: str | None = "other") -> Column:
    """Category mapping; unmapped values become ``default`` (None: NULL, to be filtered)."""
    items = [F.lit(v) for kv in mapping.items() for v in kv]
    hit = F.create_map(*items)[_c(x)]
    return hit if default is None else F.coalesce(hit, F.lit(default))


def repaired_walltime(walltime: Column | str, runtime: Column | str) -> Column:
    """Missing or shorter than the run: 1.5 x runtime, at least 0.1 h."""
    w, r = _c(walltime), _c(runtime)
    return F.when(w.isNull() | (w < r), F.greatest(r * 1.5, F.lit(0.1))).otherwise(w)


def runtime_ratio(runtime: Column | str, walltime: Column | str) -> Column:
    q = F.try_divide(_c(runtime), _c(walltime))
    return F.when(q.isNotNull(), F.least(F.greatest(q, F.lit(0.001)), F.lit(1.0)))


def size_tier(nodes: Column | str, tiers: Sequence[tuple]) -> Column:
    """First tier whose upper edge holds the node count; the last tier takes the overflow."""
    ordered = sorted(tiers, key=lambda t: t[1])
    out = None
    for t in ordered[:-1]:
        cond = _c(nodes) <= t[2]
        out = F.when(cond, t[0]) if out is None else out.when(cond, t[0])
    return F.lit(ordered[-1][0]) if out is None else out.otherwise(ordered[-1][0])


def tier_value(nodes: Column | str, tiers: Sequence[tuple], field: int) -> Column:
    """A tier attribute (walltime cap, base priority, ageing rate) by node count."""
    name = size_tier(nodes, tiers)
    return F.create_map(*[F.lit(v) for t in tiers for v in (t[0], t[field])])[name]


def alloc_offset(month: Column | str, start_month: Column | int) -> Column:
    """Months since the allocation year started, 0..11."""
    s = F.lit(start_month) if isinstance(start_month, int) else start_month
    return F.pmod(_c(month) - s, F.lit(12)).cast("int")


def cal_month_at(t_h: Column | str, start_month: int) -> Column:
    """Calendar month at an hour of a run made of 30-day months."""
    m = F.floor(F.floor(_c(t_h) / 24) / 30)
    return (F.pmod(m + (start_month - 1), F.lit(12)) + 1).cast("int")


def arrival(eligible: Column | str, submit: Column | str) -> Column:
    """Eligible time when it lies after submission, else submission."""
    return F.greatest(_c(eligible), _c(submit))


def moved_arrival(arrive_h: Column | str, submit_h: Column | str) -> Column:
    return _c(arrive_h) > _c(submit_h) + F.lit(1 / 60)


def clip_runtime(runtime: Column | str, walltime: Column | str, grace: float = 0.0) -> Column:
    r, w = _c(runtime), _c(walltime)
    return F.when(r.isNotNull() & w.isNotNull(), F.least(F.greatest(r, F.lit(0.0)), w + F.lit(float(grace))))


def bounded_slowdown(wait: Column | str, run: Column | str, tau: float = 10.0 / 60.0) -> Column:
    w, r = _c(wait), _c(run)
    return F.when(w.isNotNull() & r.isNotNull(), F.greatest(F.lit(1.0), (w + r) / F.greatest(r, F.lit(tau))))


def window_runtime(start: Column | str, end: Column | str, t1: float) -> Column:
    """Run hours inside [0, t1); an open end counts to t1; not started gives 0."""
    e = F.least(F.coalesce(_c(end), F.lit(float(t1))), F.lit(float(t1)))
    return F.coalesce(F.greatest(F.lit(0.0), e - F.greatest(F.lit(0.0), F.when(_c(start).isNotNull(), _c(start)))) *
                      F.when(_c(start).isNotNull(), F.lit(1.0)), F.lit(0.0))


def fill_scoring(df: DataFrame, defaults: Mapping[str, float] = SCORING_DEFAULTS) -> DataFrame:
    """Default every scoring parameter that is absent, NULL or not a number."""
    return df.withColumns({c: F.coalesce(number(c), F.lit(float(d))) if c in df.columns else F.lit(float(d))
                           for c, d in defaults.items()})


def queue_dim(queues: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Execution queues only, reservation queues dropped; defaults filled; NULL limit = no limit."""
    out = queues.where((F.col("queue_type") == "Execution") & ~F.col("name").rlike(RESERVATION_QUEUE))
    if names is not None:
        out = out.where(F.col("name").isin(list(names)))
    fill = {c: F.coalesce(F.col(c), F.lit(d)) for c, d in QUEUE_DEFAULTS.items() if c in queues.columns}
    fill |= {c: F.coalesce(F.col(c), F.lit(SCORING_DEFAULTS[c]))
             for c in SCORING_DEFAULTS if c in queues.columns and c not in fill}
    if "from_route_only" in queues.columns:
        fill["routable"] = F.coalesce(F.col("from_route_only"), F.lit(False))
    return out.withColumns(fill)


def exclude(df: DataFrame, col: str, regex: str | None = None, values: Sequence[str] = ()) -> DataFrame:
    """Drop rows whose ``col`` matches the anchored pattern or is listed; NULL is kept."""
    drop = F.lit(False)
    if regex:
        drop = drop | F.col(col).rlike("^(?:" + regex + ")")
    if values:
        drop = drop | F.col(col).isin(list(values))
    return df.where(~F.coalesce(drop, F.lit(False)))


def check_jobs(df: DataFrame, required: Sequence[str], keys: Sequence[str] = ("job_id",),
               text: Sequence[str] = ()) -> DataFrame:
    """Violations of the job-table contract as rows (rule, n); zero counts included."""
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    # equal keys are counted on the map side; no group of rows is ever collected
    dup = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0)).alias("n"))
    rules = {f"null_{c}": F.col(c).isNull() for c in text if c in df.columns}
    rules |= {f"nonpositive_{c}": F.col(c) <= 0 for c in ("nodes", "walltime_h") if c in df.columns}
    rules |= {f"negative_{c}": F.col(c) < 0 for c in ("runtime_h",) if c in df.columns}
    out = dup.select(F.lit("duplicate_key").alias("rule"), F.col("n").cast("long").alias("n"))
    if rules:
        one = df.agg(*[F.count_if(cond).alias(r) for r, cond in rules.items()])
        out = out.unionByName(one.select(F.explode(F.array(
            *[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])).alias("v")).select("v.*"))
    out = out.unionByName(spark.createDataFrame([("missing_columns", len(missing))], "rule string, n long"))
    return out


def band_gaps(df: DataFrame, lo: str, hi: str, first: int = 1) -> DataFrame:
    """Gaps and overlaps between adjacent distinct size bands, ordered by their ends."""
    bands = stored(numbered(df.select(lo, hi).distinct(), [], lo, [hi], "_rn"))
    before = bands.select((F.col("_rn") + 1).alias("_rn"), F.col(hi).alias("prev_hi"))
    bands = join_on(bands, before, ["_rn"], "left")
    want = F.coalesce(F.col("prev_hi") + 1, F.lit(first))
    kind = F.when(F.col(lo) > want, "gap").when(F.col(lo) < want, "overlap")
    return bands.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(lo, hi, "prev_hi", "kind")


def dense_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace nothing, add ``<col>_code``: 0-based rank of the value among the sorted distinct values."""
    for c in cols:
        cats = df.select(c).where(F.col(c).isNotNull()).distinct()
        if not isinstance(df.schema[c].dataType, (T.StringType, T.NumericType)):
            cats = cats.withColumn("_text", F.col(c).cast("string"))  # dates and times order as their text
        by = "_text" if "_text" in cats.columns else c
        codes = numbered(cats, [], by, name="_rn").select(c, (F.col("_rn") - 1).cast("int").alias(f"{c}_code"))
        df = join_on(df, per_block(codes), [c], "left")
    return df


def config_hash(cols: Sequence[str], length: int = 12) -> Column:
    """Provenance hash over a declared set of columns, independent of their order."""
    js = F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(js, 256), 1, length)


def label_json(x: Column | str) -> Column:
    """List / struct label as JSON text."""
    return F.to_json(_c(x))


def label_parse(x: Column | str, ddl: str) -> Column:
    """JSON label text back to its type; plain text gives NULL."""
    return F.from_json(_c(x), ddl)


def math_floor_div(a: Column | str, b: Column | str) -> Column:
    """``//``: floor of the quotient."""
    return F.floor(F.try_divide(_c(a), _c(b)))


def math_mod(a: Column | str, b: Column | str) -> Column:
    """``%`` with the sign of the divisor."""
    q = F.floor(F.try_divide(_c(a), _c(b)))
    return _c(a) - q * _c(b)


def math_min(*xs: Column | str) -> Column:
    """Minimum that is NULL when any argument is NULL."""
    cs = [_c(x) for x in xs]
    known = F.lit(True)
    for c in cs:
        known = known & c.isNotNull()
    return F.when(known, F.least(*cs))


def math_max(*xs: Column | str) -> Column:
    cs = [_c(x) for x in xs]
    known = F.lit(True)
    for c in cs:
        known = known & c.isNotNull()
    return F.when(known, F.greatest(*cs))


def math_clip(x: Column | str, lo: Column | float, hi: Column | float) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return math_min(math_max(_c(x), lo), hi)


def math_log(x: Column | str) -> Column:
    """Natural logarithm, NULL at or below zero."""
    return F.when(_c(x) > 0, F.ln(_c(x)))
