"""Scoring by a bigram model with deleted interpolation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodehours.llm.common import Folder, body, fold
from nodehours.llm.tally import BUCKET_KEYS, Block, answers_of, arrow_kind, counted, encoded
from nodehours.llm.words import MIX, mixed

LEARN, TUNE, HELD = 0, 1, 2  # parts of the corpus: counts, held-out counts for the weights, texts that teach nothing
END = np.uint64(0x5EED0E4D)  # stands for the end of a text
START = np.uint64(0x5EED57A7)  # the context of a first token
STEPS = 2  # cells per octave when probabilities of held-out tokens are tallied
ROUNDS = 50  # of expectation-maximisation
FLOOR = 1e-4  # least weight of the uniform part


class Tokens:
    """Tokens of a block with their contexts, and its distinct words and pairs."""

    def __init__(self, b: Block) -> None:
        vocabulary = np.concatenate([b.vocabulary, np.array([END, START], np.uint64)])
        n, end = len(b.offsets) - 1, len(vocabulary) - 2
        # every text gets an end token; the context of a token is the one before it
        self.offsets = b.offsets + np.arange(n + 1)
        token = np.full(len(b.codes) + n, end, np.int64)
        inside = np.ones(len(token), bool)
        inside[self.offsets[1:] - 1] = False
        token[inside] = b.codes
        context = np.concatenate([[0], token[:-1]])
        context[self.offsets[:-1]] = end + 1
        self.words, number = np.unique(vocabulary[:-1], return_inverse=True)  # in the order of their hashes
        self.token, self.context = number[token], np.append(number, len(self.words))[context]
        self.pairs, self.pair = np.unique(mixed(vocabulary[context] * MIX + vocabulary[token]), return_inverse=True)


def _asks(b: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct words and pairs, with their counts if the block teaches."""
    t, teaches = Tokens(b), int(b.part != HELD)
    return [(t.words, teaches * np.bincount(t.token, minlength=len(t.words))),
            (t.pairs, teaches * np.bincount(t.pair, minlength=len(t.pairs)))]


def _answer(sums: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Counts of all training texts and of those that do not tune; totals and distinct keys of both."""
    learned, all_ = sums[parts == LEARN].sum(0), sums[parts != HELD].sum(0)
    return np.stack([all_, learned]).astype("<u8"), [int(x) for x in (all_.sum(), learned.sum(), (all_ > 0).sum(), (learned > 0).sum())]


def _estimates(t: Tokens, words: np.ndarray, pairs: np.ndarray, n: int, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of each token by pair and by word, and the frequency of its context."""
    frequency = np.append(words, starts)[t.context]
    return pairs[t.pair] / np.maximum(frequency, 1), words[t.token] / max(n, 1), frequency


def _octave(frequency: np.ndarray) -> np.ndarray:
    """0 for an unseen context, otherwise 1 more than the whole part of its binary logarithm."""
    return np.where(frequency > 0, 1 + np.floor(np.log2(np.maximum(frequency, 1))), 0).astype(np.int64)


def _tallied(word_buckets: int, buckets: int, n: int, starts: int):
    """Tokens of a tuning block in cells of equal bucket and nearly equal estimates."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = blocks.to_pylist()
        t = Tokens(Block(row))
        words, pairs = (answers_of(answers, lo, hi, "<u8", 2)[1].astype(np.int64) for lo, hi in ((0, word_buckets), (word_buckets, buckets)))
        p2, p1, f = _estimates(t, words, pairs, n, starts)
        level = lambda p: np.where(p > 0, np.round(-STEPS * np.log2(np.maximum(p, 1e-300))), -1).astype(np.int64)
        cells, times = np.unique(np.column_stack([_octave(f), level(p2), level(p1)]), axis=0, return_counts=True)
        return pa.table({"b": pa.array(cells[:, 0], pa.int64()), "l2": pa.array(cells[:, 1], pa.int64()),
                         "l1": pa.array(cells[:, 2], pa.int64()), "n": pa.array(times, pa.int64())})

    return run


def weights(cells: list[tuple[int, int, int, int]], v: int) -> np.ndarray:
    """Mixture weights (pair, word, uniform) of each context bucket by expectation-maximisation.

    A bucket without held-out tokens takes the weights of the nearest one below that has some; without any at all the
    weights are set by hand. An unseen context has no pair estimate.
    """
    out = np.tile([0.4, 0.5, 0.1], (66, 1))
    out[0] = [0.0, 0.9, 0.1]
    if cells:
        a = np.array(cells, np.int64)
        chance = lambda l: np.where(l >= 0, 2.0 ** (-np.maximum(l, 0) / STEPS), 0.0)
        p = np.column_stack([chance(a[:, 1]), chance(a[:, 2]), np.full(len(a), 1 / (v + 1))])
        seen = np.unique(a[:, 0])
        for b in seen:
            mine, n, w = p[a[:, 0] == b], a[a[:, 0] == b, 3], out[b].copy()
            for _ in range(ROUNDS):
                share = mine * w
                share /= share.sum(1, keepdims=True)
                w = np.maximum(n @ share / n.sum(), [0, 0, FLOOR])
                w /= w.sum()
            out[b] = w
        for b in range(2, len(out)):
            if b not in seen and b > seen.min() and b - 1 > 0:
                out[b] = out[b - 1]
    out[0, 0] = 0
    out[0] /= out[0].sum()
    return out


def _scored(word_buckets: int, buckets: int, n: int, v: int, starts: int, mix: np.ndarray, kind: pa.DataType):
    """Sums over the tokens of each text of a block."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = blocks.to_pylist()
        b = Block(row)
        t, docs = Tokens(b), len(b.ids)
        words, pairs = (answers_of(answers, lo, hi, "<u8", 2)[0].astype(np.int64) for lo, hi in ((0, word_buckets), (word_buckets, buckets)))
        p2, p1, f = _estimates(t, words, pairs, n, starts)
        w, c = mix[_octave(f)], words[t.token]
        doc = np.repeat(np.arange(docs), np.diff(t.offsets))
        sums = lambda x: np.bincount(doc, x, docs)
        return pa.table({
            "doc_id": pa.array(b.ids, kind), "held_out": pa.array(np.full(docs, b.part == HELD)), "n_tokens": pa.array(np.diff(t.offsets), pa.int64()),
            "n_known": pa.array(sums(c > 0).astype(np.int64), pa.int64()), "train_tokens": pa.array(np.full(docs, n), pa.int64()),
            "base_score": pa.array(sums(np.log10((c + 1.0) / (n + v + 1))), pa.float64()),
            "score": pa.array(sums(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1))), pa.float64())})

    return run


def score(docs: DataFrame, modulus: int = 7, held: int = 2, tune: int = 3) -> DataFrame:
    """Log10 probability of every whole text under a model of the corpus itself.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space, with an end token after them. Texts of
    the held-out fold teach nothing. Of the others, those of fold `tune` give the held-out counts: weights
    that mix pair, word and uniform estimates are learned on them by expectation-maximisation, one
    set for each octave of the context's frequency, against counts without that fold. Scores
    then use the counts of all training texts. Keys are 64-bit hashes of words and of pairs.

    Returns one row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (each token by
    (c + 1) / (N + V + 1)), score. Null and empty texts are the end token alone. Repeated rows
    count and come back each; a null id is in the fold of the empty text. Other columns are ignored. An empty table
    gives no rows.
    """
    folder = Folder(docs.sparkSession, "lm")
    part = F.when(fold(modulus) == held, HELD).when(fold(modulus) == tune, TUNE).otherwise(LEARN)
    blocks = encoded(docs.select("doc_id", body().alias("text"), part.alias("part"), F.lit(0).alias("mark")), folder)
    tokens = blocks.agg(F.sum(F.col("n_words") + F.size("ids"))).first()[0] or 0
    pair_buckets = 1 + tokens // BUCKET_KEYS
    word_buckets = 1 + pair_buckets // 8
    buckets = word_buckets + pair_buckets
    answers = counted(blocks, _asks, [word_buckets, pair_buckets], _answer, folder)
    stat = [F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(4)]
    n, n_learn, v, v_learn = map(int, answers.where((F.col("block") < 0) & (F.col("bucket") < word_buckets)).agg(*stat).first())
    size = lambda which: F.coalesce(F.sum(F.when(which, F.size("ids"))), F.lit(0))
    starts, starts_learn = blocks.agg(size(F.col("part") != HELD), size(F.col("part") == LEARN)).first()
    replies = answers.where("block >= 0").select("block", "part", "bucket", "counts")
    cells = (blocks.where(F.col("part") == TUNE).groupBy("block").cogroup(replies.where(F.col("part") == TUNE).groupBy("block"))
             .applyInArrow(_tallied(word_buckets, buckets, n_learn, starts_learn), "b long, l2 long, l1 long, n long")
             .groupBy("b", "l2", "l1").agg(F.sum("n").alias("n")))
    mix = weights([tuple(r) for r in cells.collect()], v_learn)  # cells lie on a grid of fixed size
    kind = dict(docs.dtypes)["doc_id"]
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _scored(word_buckets, buckets, n, v, starts, mix, arrow_kind(docs, "doc_id")),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
