"""Registered queries of the operators, each over its whole table, and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nodehours.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op6_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def exact_dedup(spark, d):
    from nodehours.llm.exact import exact_groups
    return exact_groups(table(spark, d, "documents"))


def _hits(kind: int, name: str, pattern: str, group: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return (f"SELECT r, owner, repo, {kind} AS kind, '{name}' AS name, unnest(range(len(regexp_extract_all(t, {p})))) AS i, "
            f"unnest(regexp_extract_all(t, {p})) AS hit, unnest(regexp_extract_all(t, {p}, {group})) AS val, "
            f"unnest(string_split_regex(t, {p})[:len(regexp_extract_all(t, {p}))]) AS gap FROM d")


_KINDS = [("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
          ("access", "AKIA[A-Z0-9]{16,}", 0), ("hex", "[0-9a-f]{24,}", 0), ("opaque", "[A-Za-z0-9_-]{20,}", 0)]


@query("op10_secret_scan", f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner,
  coalesce(source, '') || chr(31) || coalesce(lang, '') AS repo FROM documents),
h AS ({' UNION ALL '.join(_hits(k, *x) for k, x in enumerate(_KINDS))}),
f AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM h),
s AS MATERIALIZED (SELECT *, e - length(hit) AS b FROM f WHERE (kind <> 0 OR length(val) >= 6)
  AND (kind <> 3 OR (regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')))),
w AS (SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM s GROUP BY val),
x AS (SELECT s.*, owners, repos, name || ':' || b || ':' || e AS said FROM s JOIN w USING (val) WHERE kind < 3 OR (owners <= 1
  AND NOT EXISTS (SELECT 1 FROM s o WHERE o.r = s.r AND o.kind < 3 AND o.b < s.e AND o.e > s.b))),
g AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(said, ',' ORDER BY b, kind) FILTER (WHERE kind < 3) AS base, string_agg(said, ',' ORDER BY b, kind) AS spans,
  count(*) FILTER (WHERE kind < 3 AND owners <= 1) AS n_live, count(*) FILTER (WHERE kind < 3 AND owners > 1) AS n_example,
  count(*) FILTER (WHERE kind = 3) AS n_opaque, max(repos) AS max_repositories FROM x GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_opaque, 0) AS n_opaque,
  coalesce(max_repositories, 0) AS max_repositories FROM d LEFT JOIN g USING (r)""")
def secret_scan(spark, d):
    from nodehours.llm.secrets import scan
    return scan(table(spark, d, "documents"), owner="source", repository=["source", "lang"])


@query("op3_token_counts")
def token_counts(spark, d):
    import public_tokenizers

    from nodehours.llm.tokens import count_tokens
    return count_tokens(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"), limit=1024)


@query("op8_curve_packing")
def curve_packing(spark, d):
    import public_tokenizers

    from nodehours.llm.packing import pack
    return pack(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=2048, end_id=1)


@query("op9_toxicity")
def toxicity_scores(spark, d):
    from pyspark.sql import functions as F

    from nodehours.llm.toxicity import toxicity
    out = toxicity(table(spark, d, "documents"), table(spark, d, "labels"), "toxic", 5, 0, threshold=0.5)
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"),
                      F.array_min("passages.evalue").alias("best_evalue"))


@query("op5_quality")
def quality_scores(spark, d):
    from nodehours.llm.quality import quality
    return quality(table(spark, d, "documents"), table(spark, d, "labels"), "quality", 4, 2, threshold=0.7)


@query("op1_lm_score")
def lm_score(spark, d):
    from nodehours.llm.lm import score
    return score(table(spark, d, "documents"), modulus=7, held=2)


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""


@query("op4_jaccard_join", f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
c AS MATERIALIZED (SELECT list_sort(sh) AS sh, min(doc_id) AS rep, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY ALL),
p AS (SELECT rep, n, unnest(sh) AS x FROM c),
k AS MATERIALIZED (SELECT x, count(*) AS df FROM p GROUP BY x),
r AS MATERIALIZED (SELECT rep, n, x FROM (SELECT rep, n, x, row_number() OVER (PARTITION BY rep ORDER BY df, x) AS i FROM p JOIN k USING (x)) WHERE 100 * i <= 10 * n + 100),
near AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM r a JOIN r b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
l AS MATERIALIZED (SELECT a, b FROM near JOIN c x ON x.rep = a JOIN c y ON y.rep = b
  WHERE 100 * len(list_intersect(x.sh, y.sh)) >= 90 * (x.n + y.n - len(list_intersect(x.sh, y.sh)))),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
g AS (SELECT b AS rep, min(a) AS component_id FROM reach GROUP BY b)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(g.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh AND len(s.sh) > 0 LEFT JOIN g USING (rep)""")
def jaccard_join(spark, d):
    from nodehours.llm.jaccard import jaccard_groups
    return jaccard_groups(table(spark, d, "documents"), width=3, percent=90)


@query("op7_decontamination")
def decontamination(spark, d):
    from nodehours.llm.decontaminate import contaminated
    return contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"), width=5, least=0.8)


@query("op2_line_dedup")
def line_dedup(spark, d):
    from pyspark.sql import functions as F

    from nodehours.llm.common import body
    from nodehours.llm.lines import dedup_lines
    docs = table(spark, d, "documents")
    lines = lambda c: F.size(F.split(c, "\n")).cast("long")
    sized = docs.select("doc_id", "text", lines(body()).alias("n_lines"), F.octet_length(body()).cast("long").alias("n_bytes"))
    out = dedup_lines(sized, least_words=5, similarity=0.8)
    return out.select("doc_id", "n_lines", "n_bytes",
                      lines(F.coalesce("text", F.lit(""))).alias("kept_lines"),
                      F.octet_length(body()).cast("long").alias("kept_bytes"), F.sha2(body(), 256).alias("kept_sha256"))


@query("op11_mixing", r"""
WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  substr(md5(coalesce(doc_id::VARCHAR, '') || '||' || md5(coalesce(text, ''))), 1, 15) AS h FROM documents),
s AS MATERIALIZED (SELECT *, 10 // w AS m, 3 * z AS cap FROM (SELECT source, sum(size)::BIGINT AS z,
  row_number() OVER (ORDER BY source NULLS LAST) AS rank, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM d GROUP BY source)),
b AS (SELECT sum(z)::BIGINT AS budget, sum(w) FILTER (WHERE cap > 0) AS weight FROM s),
l AS (SELECT last, sum(cap) OVER (ORDER BY last) AS given, sum(w) OVER (ORDER BY last) AS v
  FROM (SELECT cap * m AS last, sum(cap) AS cap, sum(w) AS w FROM s WHERE cap > 0 GROUP BY ALL)),
dry AS (SELECT coalesce(max(last), 0)::BIGINT AS last, coalesce(max(given), 0)::BIGINT AS given, coalesce(max(v), 0)::BIGINT AS v FROM l, b
  WHERE given * 10 + (weight - v) * last <= budget::HUGEINT * 10),
u AS MATERIALIZED (SELECT last, budget, (budget - given)::BIGINT AS lft, (weight - v)::BIGINT AS others FROM dry, b),
f AS (SELECT max(t) AS t, max(g)::BIGINT AS g FROM (SELECT t, sum(least(cap, t // m)) AS g FROM (SELECT unnest(range(lft * 10 // others, lft * 10 // others + 11)) AS t FROM u), s GROUP BY t), u
  WHERE g <= budget),
r AS (SELECT s.*, least(cap, t // m) + CASE WHEN (t + 1) % m = 0 AND (t + 1) // m <= cap AND count(*) FILTER (WHERE (t + 1) % m = 0 AND (t + 1) // m <= cap) OVER (ORDER BY rank)
  <= u.budget - f.g THEN 1 ELSE 0 END AS upto, CASE WHEN cap * m <= u.last THEN cap::DOUBLE ELSE w::DOUBLE * lft::DOUBLE / others::DOUBLE END AS target FROM s, f, u),
q AS (SELECT d.*, (sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before FROM d)
SELECT doc_id, size, z AS source_size, target, (greatest(0, least(size, upto - before)) + greatest(0, least(size, upto - z - before))
  + greatest(0, least(size, upto - 2 * z - before)))::BIGINT AS taken FROM q JOIN r ON q.source IS NOT DISTINCT FROM r.source""")
def source_mixing(spark, d):
    from nodehours.llm.mixing import mix
    return mix(table(spark, d, "documents"), weights=(5, 2, 1), most=3).select("doc_id", "size", "source_size", "target", "taken")


@query("op12_whitening")
def embedding_whitening(spark, d):
    from pyspark.sql import functions as F

    from nodehours.llm.whitening import whiten
    out = whiten(table(spark, d, "embeddings"), "vec_id", "embedding", components=16, scale=64, shift=1_000_000)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


@query("op13_collocations", r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS ws FROM t),
f AS MATERIALIZED (SELECT lang, g, len(g) AS k, count(*) AS a FROM (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda m:
  list_transform(range(1, len(ws) - m + 2), lambda i: ws[i:i + m - 1])))) AS g FROM p) GROUP BY lang, g HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, g, k, a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.g, c.a, c.cut, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a) AS score FROM c JOIN n USING (lang)
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.cut + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
o AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m:
  list_transform(range(1, k - m + 2), lambda i: g[i:i + m - 1])))) AS part FROM f WHERE k > 2) GROUP BY lang, part),
d AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.part = b.g WHERE longer IS NULL OR longer < a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d) WHERE rank <= 2000""")
def phrase_collocations(spark, d):
    from nodehours.llm.phrases import collocations
    return collocations(table(spark, d, "documents"), most_words=5, least=100, percent=100, top=2000)


@query("pipeline")
def pipeline(spark, d):
    import corpus_pipeline
    return corpus_pipeline.run(spark, d)
