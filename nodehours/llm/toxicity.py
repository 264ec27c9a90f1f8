"""Toxic passages as maximal scoring segments of token log-odds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodehours.llm.common import Folder, body, fold
from nodehours.llm.labelled import training_rows
from nodehours.llm.words import sliced, stripped, words

FIT_ROWS = 20_000  # labelled rows that word scores and calibration are learned from, at most
LEAST_Z = 3.5  # standard errors a word's log-odds must differ from 0 by
PRIOR = 1000.0  # weight of the Dirichlet prior, spread as the pooled word frequencies
FLOOR = 1.0  # prior count of each word besides
SIGNIFICANT = 0.01  # E-value up to which a passage is reported


@dataclass
class Model:
    """Word scores, the score of all other words, and the calibration."""

    scores: dict[str, float]
    other: float = -0.01
    decay: float = 1.0  # lambda of the extreme-value law
    scale: float = 1.0  # K of the law
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)


def segments(left: list[float], right: list[float], first: list[int], last: list[int]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, in time linear in the number of positive scores.

    left and right are the cumulative sums before and after each positive score, first and last its place.
    """
    kept: list[tuple[float, float, int, int, int]] = []  # sums, places, and the nearest kept one that starts lower
    for lo, hi, a, b in zip(left, right, first, last, strict=True):
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= lo:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= hi:
                break
            lo, a = kept[j][0], kept[j][2]
            j2 = kept[j][4]
            del kept[j:]
            j = j2
        kept.append((lo, hi, a, b, j))
    return [(hi - lo, a, b + 1) for lo, hi, a, b, _ in kept]


def _scanned(texts: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
    """Number of words and maximal segments of each text."""
    offsets, codes, vocabulary = stripped(*words(texts))
    of = np.fromiter((model.scores.get(w, model.other) for w in vocabulary), np.float64, len(vocabulary))
    s = of[codes] if len(codes) else np.zeros(0)
    total = np.cumsum(s)
    hits = np.flatnonzero(s > 0)
    cut = np.searchsorted(hits, offsets)
    for i in range(len(texts)):
        at = hits[cut[i]:cut[i + 1]]
        found = []
        if len(at):
            right, places = total[at], (at - offsets[i]).tolist()
            found = segments((right - s[at]).tolist(), right.tolist(), places, places)
        yield int(offsets[i + 1] - offsets[i]), found


def _evidence(n: int, found: list[tuple[float, int, int]], decay: float, scale: float) -> tuple[float, float]:
    """What the passages together, and the best one, exceed by what chance gives in n words (in nats)."""
    chance = math.log(max(scale * max(n, 1), 1e-9))
    over = [max(0.0, decay * s - chance) for s, _, _ in found]
    return math.log1p(sum(over)), math.log1p(max(over, default=0.0))


def _probability(w: tuple[float, float, float], both: float, best: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * both + w[2] * best))))


def _decay(shares: list[tuple[float, float]]) -> float:
    """Lambda of the law: the positive root of sum(p * exp(lambda * s)) = 1 over scores s and their shares p among clean words.

    Scores that are exactly log-odds of the two kinds of text give 1; thresholds, the prior and the floor of the other
    words' score move it. It is 1 where there is no root, that is without both positive scores and a negative mean.
    """
    p, s = (np.array(x, float) for x in zip(*shares, strict=True))
    if s.max() <= 0 or p[s > 0].sum() <= 0 or p @ s >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    excess = lambda x: p @ np.expm1(x * s)
    while excess(hi) < 0:
        lo, hi = hi, 2 * hi
    for _ in range(60):  # below 0 between 0 and the root, above 0 beyond it
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return hi


def _word_scores(sample: DataFrame, folder: Folder) -> tuple[dict[str, float], float, float]:
    """Log-odds of each word in toxic against other texts, with an informative Dirichlet prior; of all others; and lambda.

    A word counts once in a text, so that one long text cannot make a word look toxic. Every word whose log-odds are
    LEAST_Z standard errors from 0 has a score of its own; the sample of labelled rows bounds their number.
    """

    def count(batches):
        for b in sliced(batches):
            offsets, codes, vocabulary = stripped(*words(b["text"]))
            size = max(len(vocabulary), 1)
            once = np.unique(np.repeat(np.arange(b.num_rows), np.diff(offsets)) * size + codes)
            y, codes = np.asarray(b["y"]).astype(bool)[once // size], once % size
            yield pa.record_batch({"word": pa.array(vocabulary, pa.string()),
                                   "n1": pa.array(np.bincount(codes[y], minlength=len(vocabulary)), pa.int64()),
                                   "n0": pa.array(np.bincount(codes[~y], minlength=len(vocabulary)), pa.int64())})

    counts = folder.put(sample.select("text", "y").mapInArrow(count, "word string, n1 long, n0 long")
                        .groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "words")
    t1, t0 = counts.agg(F.sum("n1"), F.sum("n0")).first()
    if not t1 or not t0:
        return {}, -0.01, 1.0
    prior = (F.col("n1") + F.col("n0")) * F.lit(PRIOR / (t1 + t0)) + FLOOR
    odds = lambda n, t: F.log((n + prior) / (F.lit(t + PRIOR) - n - prior))
    delta = odds(F.col("n1"), t1) - odds(F.col("n0"), t0)
    z = delta / F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    top = (counts.where((F.col("n1") + F.col("n0")) * 2 < t1 + t0).withColumn("delta", delta).withColumn("z", z)
           .where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").collect())
    # all words without a score of their own are one type; its log-odds are what a plain word adds to a passage
    plain1, plain0 = t1 - sum(r.n1 for r in top), t0 - sum(r.n0 for r in top)
    other = math.log((plain1 + 1) / (t1 + 2)) - math.log((plain0 + 1) / (t0 + 2))
    other = min(other, -0.005)
    return {r.word: r.delta for r in top}, other, _decay([(r.n0 / t0, r.delta) for r in top] + [(plain0 / t0, other)])


def _regress(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, lightly penalised."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, a.T @ (y - p) - 0.1 * w)
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, fit_rows: int = FIT_ROWS) -> Model:
    """Word scores, extreme-value law and calibration from at most fit_rows labelled rows.

    Scores come from three fifths of the rows, law and calibration from the others. The law's lambda follows from
    the scores of clean words (_decay); its K is that under which the best segments of clean rows are likeliest.
    """
    folder = Folder(docs.sparkSession, "toxic")
    sample = folder.put(training_rows(docs, labels, label, modulus, held, fit_rows), "sample")
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(5))
    model = Model(*_word_scores(sample.where(part < 3), folder))
    rest = sample.where(part >= 3).select("text", "y")

    def scan(batches):
        for b in sliced(batches):
            n, found = zip(*_scanned(b["text"], model), strict=True) if b.num_rows else ((), ())
            yield pa.record_batch({"n": pa.array(n, pa.int64()), "y": b["y"],
                                   "s": pa.array([[f[0] for f in x] for x in found], pa.list_(pa.float64()))})

    rows = rest.mapInArrow(scan, "n long, y int, s array<double>").collect()  # at most fit_rows short rows
    clean = [(r.n, max(r.s, default=0.0)) for r in rows if r.y == 0 and r.n]
    if clean:
        model.scale = len(clean) / sum(n * math.exp(-model.decay * s) for n, s in clean)
    y = np.array([r.y for r in rows], float)
    if len(y) and 0 < y.sum() < len(y):
        x = np.array([_evidence(r.n, [(s, 0, 0) for s in r.s], model.decay, model.scale) for r in rows])
        model.weights = _regress(x, y)
    elif len(y):
        model.weights = (math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0, 0.0)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Toxicity of each text: probability, verdict, and every significant passage.

    Words are lower-cased, freed of punctuation at their ends, and scored; a linear scan finds all maximal scoring segments. A segment of score S in
    n words has E-value K n exp(-lambda S); what the segments exceed chance by is summed and mapped to a
    probability. Returns doc_id, score, predicted, passages (first word, word after the last, score, E-value).
    Null and empty texts have no passages and the score of a text without evidence.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        w = model.weights
        for b in sliced(batches):
            p, passages = [], []
            for n, found in _scanned(b["text"], model):
                both, best = _evidence(n, found, model.decay, model.scale)
                p.append(_probability(w, both, best))
                said = ((a, z, s, model.scale * n * math.exp(-model.decay * s)) for s, a, z in found)
                passages.append([dict(zip(("first", "end", "score", "evalue"), x, strict=True)) for x in said if x[3] <= SIGNIFICANT])
            kinds = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("evalue", pa.float64())]))
            yield pa.record_batch({"doc_id": b["doc_id"], "score": pa.array(p, pa.float64()),
                                   "predicted": pa.array([int(x >= threshold) for x in p], pa.int32()), "passages": pa.array(passages, kinds)})

    return docs.select("doc_id", body().alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int, passages array<struct<first:long,end:long,score:double,evalue:double>>")


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0,
                  threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold; fitted as in toxicity."""
    model = fit(docs, labels, label, modulus, held, fit_rows)

    def run(batches):
        w = model.weights
        for b in sliced(batches):
            keep = []
            for n, found in _scanned(b["text"], model):
                both, best = _evidence(n, found, model.decay, model.scale)
                keep.append(_probability(w, both, best) < threshold)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0,
             threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fit on the rows outside the held-out fold and score every row.

    Returns one row per input row: doc_id, held_out, score, predicted, passages. Without labels of both classes the
    score is the rate of label 1 (0.5 without any). Repeated rows and null ids are scored like others;
    columns beside doc_id and text are ignored; an empty table gives no rows.
    """
    out = score(docs, fit(docs, labels, label, modulus, held, fit_rows), threshold)
    return out.select("doc_id", (fold(modulus) == held).alias("held_out"), "score", "predicted", "passages")
