"""Quality of texts from learned vectors of words and their character n-grams."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodehours.llm.common import Folder, body, fold
from nodehours.llm.labelled import training_rows
from nodehours.llm.words import MIX, hashes, mixed, sliced, words

FIT_ROWS = 2_000  # labelled rows of each class that vectors are learned from, at most
BUCKETS = 1 << 17  # hashed features, each with a vector
DIM = 12
GRAMS = (3, 4)  # lengths in bytes of character n-grams, word ends marked
EPOCHS = 5
RATE = 0.1
BATCH_BYTES = 5 << 20  # text handled at a time


@dataclass
class Model:
    """Vectors of features, and weights and bias of the two classes."""

    vectors: np.ndarray
    softmax: np.ndarray
    shift: float  # log-odds of the classes at large against those in the sample

    def lean(self) -> np.ndarray:
        """What each feature adds to the log-odds of class 1: the softmax of two classes sees vectors only so."""
        return self.vectors.astype(np.float64) @ (self.softmax[1] - self.softmax[0])


def features(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words one after the other, and offsets: the word itself, and n-grams of <word>."""
    marked = [b"<" + w.encode() + b">" for w in vocabulary]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(marked)), size)
    found, whose = [mixed(hashes(vocabulary))], [np.arange(len(marked))]
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(raw)) + n <= end[owner]) if len(raw) else np.zeros(0, np.int64)
        code = np.full(len(at), n, np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | raw[at + k]
        found.append(mixed(code))
        whose.append(owner[at])
    whose_all = np.concatenate(whose)
    order = np.argsort(whose_all, kind="stable")
    bucket = (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int64)
    return bucket, np.concatenate([[0], np.cumsum(np.bincount(whose_all, minlength=len(vocabulary)))])


def pairs(offsets: np.ndarray, codes: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """Feature number of each word's pair with the word before it in its text, -1 for a first word.

    A word that repeats the one before is the same feature whatever the word.
    """
    h = hashes(vocabulary)[codes] if len(codes) else np.zeros(0, np.uint64)
    before = np.concatenate([h[:1], h[:-1]])
    joint = np.where(h == before, np.uint64(1), mixed(before * MIX + h))
    out = (mixed(joint + MIX) % np.uint64(BUCKETS)).astype(np.int64)
    out[offsets[:-1][np.diff(offsets) > 0]] = -1
    return out


def _bags(sample: DataFrame) -> DataFrame:
    """Distinct features of each training text with their counts; at most BUCKETS a text."""

    def run(batches):
        for b in sliced(batches, most_bytes=BATCH_BYTES):
            offsets, codes, vocabulary = words(b["text"], lower=False)
            bucket, at = features(vocabulary)
            pair = pairs(offsets, codes, vocabulary)
            ids, counts = [], []
            for i in range(b.num_rows):
                code, times = np.unique(codes[offsets[i]:offsets[i + 1]], return_counts=True)
                n = at[code + 1] - at[code]
                place = np.repeat(at[code] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(code) else np.zeros(0, np.int64)
                two = pair[offsets[i]:offsets[i + 1]][1:]
                have, inverse = np.unique(np.concatenate([bucket[place], two]), return_inverse=True)
                ids.append(have.astype("<i4").tobytes())
                counts.append(np.bincount(inverse, np.concatenate([np.repeat(times, n), np.ones(len(two))]), len(have)).astype("<f4").tobytes())
            yield pa.record_batch({"doc_id": pa.array([str(x) for x in b["doc_id"]], pa.string()), "y": b["y"],
                                   "ids": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id string, y int, ids binary, counts binary")


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], rate1: float, seed: int = 3) -> Model:
    """Stochastic gradient descent over (label, features, counts); rate1 is the share of label 1 at large."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), np.zeros((2, DIM)), 0.0)
    ones = sum(y for y, _, _ in bags)
    if not bags or ones in (0, len(bags)):
        model.shift = math.log((rate1 + 1e-3) / (1 - rate1 + 1e-3))
        return model
    model.shift = math.log(rate1 / (1 - rate1)) - math.log(ones / (len(bags) - ones))
    step, steps = 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            y, ids, weights = bags[k]
            rate, step = RATE * (1 - step / steps), step + 1
            if not len(ids):
                continue
            hidden = weights @ model.vectors[ids]
            z = model.softmax @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ model.softmax
            model.softmax -= rate * np.outer(p, hidden)
            # a text's features share its step; each moves by its weight in the average, scaled to the number of features
            model.vectors[ids] -= (rate * len(ids)) * weights[:, None] * back.astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from at most fit_rows labelled rows of each class outside the held-out fold."""
    folder = Folder(docs.sparkSession, "quality")
    rows = folder.put(_bags(training_rows(docs, labels, label, modulus, held, fit_rows, per_class=True)), "bags").collect()
    rows = sorted((r.doc_id, r.y, bytes(r.ids), bytes(r.counts)) for r in rows)  # a bounded sample; order fixes the steps
    bags = []
    for _, y, ids, counts in rows:
        c = np.frombuffer(counts, "<f4")
        bags.append((y, np.frombuffer(ids, "<i4"), c / c.sum() if len(c) else c))
    known = labels.where(F.col(label).isNotNull() & (fold(modulus) != held))
    rate1 = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train(bags, 0.5 if rate1 is None else min(max(rate1, 1e-3), 1 - 1e-3))


def score(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """Probability of label 1 for each text; returns doc_id, score, predicted."""
    kind, lean, shift = dict(docs.dtypes)["doc_id"], model.lean(), model.shift

    def run(batches):
        for b in sliced(batches, most_bytes=BATCH_BYTES):
            offsets, codes, vocabulary = words(b["text"], lower=False)
            bucket, at = features(vocabulary)
            count = np.diff(at)
            total = np.add.reduceat(lean[bucket], at[:-1]) if len(vocabulary) else np.zeros(0)
            pair = pairs(offsets, codes, vocabulary)
            follows = pair >= 0
            up = np.concatenate([[0], np.cumsum(total[codes] + np.where(follows, lean[pair], 0.0))])
            down = np.concatenate([[0], np.cumsum(count[codes] + follows)])
            z = (up[offsets[1:]] - up[offsets[:-1]]) / np.maximum(down[offsets[1:]] - down[offsets[:-1]], 1) + shift
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.record_batch({"doc_id": b["doc_id"], "score": pa.array(p, pa.float64()),
                                   "predicted": pa.array((p >= threshold).astype(np.int32), pa.int32())})

    return docs.select("doc_id", body().alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2,
            threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Learn on rows outside the held-out fold and score every whole text.

    Words keep their case. A text is the average of the vectors of all its words, their character n-grams and pairs of words, mapped to two
    classes by a softmax; vectors and softmax are learned together. Classes are sampled evenly and scores
    moved back to the rate of the labels. Returns one row per input row: doc_id, held_out, score, predicted (1 from
    threshold on). Null and empty texts get the rate of label 1 as learned (0.5 without any labels); repeated
    rows and null ids are scored like others; other columns are ignored; an empty table gives no rows.
    """
    out = score(docs, fit(docs, labels, label, modulus, held, fit_rows), threshold)
    return out.select("doc_id", (fold(modulus) == held).alias("held_out"), "score", "predicted")
