"""Source mixing, whitening and phrase mining against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from nodehours.llm import phrases
from nodehours.llm.eigen import above, leading, tridiagonal
from nodehours.llm.mixing import mix, stream
from nodehours.llm.phrases import collocations, pieces
from nodehours.llm.trie import DoubleArray
from nodehours.llm.whitening import deviations, whiten
from tests.llm import cases

import pyarrow as pa


@pytest.fixture(scope="module")
def rows():
    return cases.awkward(cases.documents(150, "/root/testdata/sf0.001"))


# ------------------------------------------------------------------ mixing


def filled(sizes, weights, budget, most):
    """Targets by resharing the excess until none is above its limit."""
    out, open_ = {}, dict.fromkeys(sizes)
    left = budget
    while open_:
        whole = sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * left / whole >= most * sizes[s]]
        if not over:
            return out | {s: weights[s] * left / whole for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            del open_[s]
    return out


@pytest.mark.parametrize("weights,most,share", [((5, 2, 1), 3, 1), ((1, 7), 2, 0.4), ((3,), 3, 5)])
def test_mix_takes_the_words_that_finish_first(spark, rows, weights, most, share):
    rows = [(*r[:3], None if r[3] is None else "tiny" if k == 3 else r[3], r[4]) for k, r in enumerate(rows)]
    size = lambda t: len(cases.words(t))
    total = sum(size(r[1]) for r in rows)
    budget = int(total * share)
    docs = cases.frame(spark, rows)
    got = mix(docs, weights, most, None if share == 1 else budget).collect()
    assert len(got) == len(rows)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    unit = math.lcm(*weights)
    of = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    step = {s: unit // weights[k % len(weights)] for k, s in enumerate(sources)}
    target = filled({s: z for s, z in of.items() if z}, {s: unit // step[s] for s in of}, budget, most)
    # word by word: the p-th word of a source finishes at p * step
    words = sorted((p * step[s], k) for k, s in enumerate(sources) for p in range(1, most * of[s] + 1))[:budget]
    upto = Counter(k for _, k in words)
    want = []
    for k, s in enumerate(sources):
        order = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5((("" if r[0] is None else str(r[0])) + "||" + hashlib.md5((r[1] or "").encode()).hexdigest()).encode()).hexdigest()[:15],
                                                                     r[0] is not None, r[0] or 0, size(r[1])))
        before = 0
        for r in order:
            z = size(r[1])
            taken = sum(max(0, min(z, upto[k] - c * of[s] - before)) for c in range(most))
            want.append((r[0], z, of[s], taken))
            before += z
    assert Counter((r.doc_id, r["size"], r.source_size, r.taken) for r in got) == Counter(want)
    assert sum(r.taken for r in got) == min(budget, most * total)
    assert all(r.taken <= most * r["size"] for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.source_size].add(r.target)
        assert sum(x.words for x in r.finishes) == r.taken
    for s in target:
        assert any(math.isclose(target[s], x, rel_tol=1e-9) for x in by[of[s]])
        assert abs(upto[sources.index(s)] - target[s]) <= max(weights) + 1
    assert sorted(map(str, mix(docs.repartition(7), weights, most, None if share == 1 else budget).collect())) == sorted(map(str, got))


def test_mixed_stream_is_ordered(spark, rows):
    docs = cases.frame(spark, rows)
    mixed = mix(docs)
    out = stream(docs, mixed)
    assert out.columns == [*docs.columns, "copy_finish", "copy_words"]
    got = out.collect()
    assert [r.copy_finish for r in got] == sorted(r.copy_finish for r in got)
    assert sum(r.copy_words for r in got) == mixed.agg(F.sum("taken")).first()[0]
    assert mix(cases.empty(spark)).count() == 0


# ------------------------------------------------------------------ whitening


def matrices():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 40):
        a = rng.standard_normal((n, n))
        q, _ = np.linalg.qr(a)
        close = np.ones(n)
        close[:n // 2] = 2
        close[0] = 2 + 1e-9
        yield from (a @ a.T, 3 * np.eye(n), q @ np.diag(close) @ q.T, np.outer(a[:, 0], a[:, 0]), np.diag(rng.random(n) * 1e6), np.zeros((n, n)))


def test_leading_components_of_any_matrix():
    for a in matrices():
        a = (a + a.T) / 2
        k = min(16, len(a))
        values, vectors = leading(a, k)
        size = np.abs(a).max() or 1
        assert np.allclose(values / size, np.linalg.eigvalsh(a)[::-1][:k] / size, atol=1e-12)
        assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-11) and np.allclose(a @ vectors.T / size, vectors.T * values / size, atol=1e-11)
        if len(a) > 2:
            d, e, _ = tridiagonal(a)
            at = np.linspace(-size, size, 9) + 0.1234 * size / len(a)
            assert (above(d, e, at) == (np.linalg.eigvalsh(a)[None, :] > at[:, None]).sum(1)).all()


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 12)).astype(np.float32) @ rng.standard_normal((12, 12)).astype(np.float32)
    data = [(i, [float(x) for x in v], i) for i, v in enumerate(base)] + [(i + 1000, [float(x) for x in base[0]], 0) for i in range(150)]
    data += [(2000, None, 0), (2001, [1.0, None] * 6, 0), (2002, [float("nan")] + [1.0] * 11, 0), (2003, [float("inf")] + [1.0] * 11, 0),
             (None, [0.5] * 12, 0), (2004, [1.0, 2.0], 0), (2004, [1.0, 2.0], 0), (2005, [], 0)]
    docs = spark.createDataFrame(data, "vec_id long, embedding array<float>, n int").withColumn("x", F.lit(1)).withColumn("id", F.lit(2)).repartition(5)
    got = whiten(docs, components=5).collect()
    kept = [(i, v + [0.0] * (12 - len(v))) for i, v, _ in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    d = fit - s / n
    values, axes = np.linalg.eigh(d.T @ d / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = Counter()
    told = defaultdict(list)
    for r in got:
        told[r.component].append(r)
        want[r.vec_id, r.component, int(r.deviation)] += 1
    assert want == Counter((i, c, int(v)) for (i, _), v in zip(kept, ((n * x - s) ** 2).sum(1), strict=True) for c in range(1, 6))
    for c, rs in told.items():
        mine = {(r.vec_id, int(r.deviation)): r.whitened for r in rs}
        ref = np.array([((x[k] - s / n) @ axes[:, c - 1]) / math.sqrt(values[c - 1]) for k in range(len(kept))])
        have = np.array([mine[i, int(((n * x[k] - s) ** 2).sum())] for k, (i, _) in enumerate(kept)])
        assert min(np.abs(ref - have).max(), np.abs(ref + have).max()) < 1e-9
        assert all(math.isclose(r.explained, values[c - 1] / values.sum(), rel_tol=1e-9) and r.n == n and r.identity_error < 1e-9 for r in rs)
    assert whiten(docs.limit(0)).count() == 0 and whiten(docs.where("vec_id >= 1000 AND vec_id < 1100")).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(8)], "vec_id long, embedding array<double>")
    assert {r.component for r in whiten(line).collect()} == {1}  # the other one has no variance


def test_deviations_beyond_64_bits():
    x, sums, n = np.array([[1 << 52, -(1 << 52)], [3, 4]]), [5, 1 << 60], 10 ** 6
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert deviations(x, n, sums).to_pylist() == [Decimal(v) if v < 10 ** 38 else None for v in want]


# ------------------------------------------------------------------ phrases


def cut(text):
    out = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(cases.LOWER))]
    return [p for p in out if p]


def test_pieces_equal_regular_expressions(rows):
    rng = np.random.default_rng(4)
    odd = ["".join(rng.choice(list("aB \t.,\n\x0b\x85 é日!"), rng.integers(0, 30))) for _ in range(400)]
    texts = [r[1] for r in rows] + odd + [None, ""]
    codes, vocabulary = pieces(pa.concat_arrays([pa.array(["x y", *texts], pa.string())]).slice(1))
    said, want = [vocabulary[c].as_py() if c >= 0 else None for c in codes], []
    for t in texts:
        for p in cut(t):
            want += ([None] if want else []) + p
    assert said == want


def test_trie_counts_what_it_holds(monkeypatch):
    rng = np.random.default_rng(6)
    for size in (1, 3, 40, 2000):
        rows = {tuple(rng.integers(0, 12, rng.integers(1, 5)).tolist()) for _ in range(size)}
        rows = sorted(rows)
        labels = rng.permutation(len(rows)) + 7
        trie = DoubleArray(np.array([[*r, *[-1] * (4 - len(r))] for r in rows]) * 5, labels)
        text = rng.integers(-1, 13, 5000)
        text = np.where(text >= 0, text * 5, -1)
        codes, seen = trie.codes_of(text), np.zeros(len(trie.check), np.int64)
        for lo in range(0, len(codes), 700):
            trie.visit(codes[lo:lo + 703], 700, seen)
        got = {int(trie.label[s]): int(seen[s]) for s in np.flatnonzero((seen > 0) & (trie.label >= 0))}
        want = {int(x): n for r, x in zip(rows, labels, strict=True)
                if (n := sum(text[i:i + len(r)].tolist() == [5 * c for c in r] for i in range(len(text) - len(r) + 1)))}
        assert got == want


def mined(rows, most, least, percent, top):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for p in cut(t):
            n[lang] += len(p)
            f[lang].update(tuple(p[i:i + k]) for k in range(1, most + 1) for i in range(len(p) - k + 1))
    out = []
    for lang, c in f.items():
        some = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        longer = Counter()
        for g, a in some.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longer[g[i:i + k]] = max(longer[g[i:i + k]], a)
        rank = []
        for g, a in some.items():
            if g in longer and 100 * longer[g] >= percent * a:
                continue
            score, _, left, right = min((1000 * a * n[lang] // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            rank.append((-score, -a, " ".join(g).encode(), left, right))
        for i, (s, a, g, left, right) in enumerate(sorted(rank)[:top]):
            out.append((lang, i + 1, g.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("most,least,percent,top,part", [(5, 6, 100, 40, 500_000), (3, 4, 80, 10 ** 6, 300)])
def test_collocations(spark, rows, monkeypatch, most, least, percent, top, part):
    monkeypatch.setattr("nodehours.llm.phrases.PART", part)  # one trie, or many
    monkeypatch.setattr("nodehours.llm.phrases.WORD_BYTES", 16 << 20 if part > 300 else 0)
    more = [(5_000_000 + i, "Deep sea, deep sea\tdeep sea deep sea; new york! New York new", "und", None, None) for i in range(8)]
    rows = [r for r in rows if r[0] != 900_004] + more
    got = collocations(cases.frame(spark, rows), most, least, percent, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = mined(rows, most, least, percent, top)
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == want


def test_collocations_of_a_long_text_and_of_nothing(spark):
    long = [(1, " ".join(f"w{i % 977} and thé 日本" for i in range(20_000)), "xx", None, None)]
    assert sorted(map(tuple, collocations(cases.frame(spark, long), least=15, top=100).collect())) == mined(long, 5, 15, 100, 100)
    assert collocations(cases.empty(spark)).count() == 0
    assert collocations(cases.frame(spark, [(1, None, None, None, None), (2, "one two", "en", None, None)])).count() == 0


def test_collocations_take_no_trie_through_the_driver(spark, rows, monkeypatch):
    def in_a_task(*a):
        assert TaskContext.get() is not None
        return DoubleArray(*a)

    monkeypatch.setattr(phrases, "DoubleArray", in_a_task)
    monkeypatch.setattr(phrases, "SIEVE_BITS", 8, raising=False)  # sieves that nearly all passes only make more candidates
    got = collocations(cases.frame(spark, rows), 4, 5, 100, 50)
    assert sorted(map(tuple, got.collect())) == mined(rows, 4, 5, 100, 50)


def test_counters_follow_the_corpus(spark, rows, monkeypatch):
    """Of pairs that occur too rarely hardly any pass, however many words the corpus has."""
    reached, seen = phrases._reached, []

    def noted(blocks, kept, k, least, n):
        sieve = reached(blocks, kept, k, least, n)
        if k == 2:
            seen.append((n, sieve, reached(blocks, kept, k, least, 10 ** 12)))
        return sieve

    monkeypatch.setattr(phrases, "_reached", noted)
    collocations(cases.frame(spark, rows), 3, 5, 100, 50).collect()
    (n, *sieves), = seen
    other = phrases.mixed(np.arange(1, 500_001, dtype=np.uint64))
    for words, sieve in zip((n, 10 ** 12), sieves, strict=True):
        assert 1 << (64 - int(sieve.shift)) >= 8 * words
        assert len(sieve.passing(other)) < 5_000
        assert len(sieve.bits) < 1 << 20


def test_windows_count_every_position_once(spark):
    """A text longer than a stretch: what begins in the words shared by two of them counts once."""
    words = phrases.SLICE + 40_000
    long = [(1, " ".join(f"w{i * i % 211}" for i in range(words)), "xx", None, None), (2, "w1 w4. w9 w16 w25", "xx", None, None)]
    assert sorted(map(tuple, collocations(cases.frame(spark, long), least=1000, top=500).collect())) == mined(long, 5, 1000, 100, 500)


def test_rows_of_windows_survive_their_bytes():
    rng = np.random.default_rng(3)
    for n in (0, 1, 500):
        rows = rng.integers(-1, 1 << 40, (n, 5)) * rng.integers(0, 2, (n, 5))
        assert np.array_equal(phrases._got_rows(phrases._put_rows(rows), 5), rows)
        key = np.zeros(n, np.uint64)  # one hash for all: equal rows may stand twice, none is lost or mixed with another
        some, _, counts = phrases._distinct(np.repeat(rows, 3, 0), np.repeat(key, 3), np.ones(3 * n, np.int64))
        assert Counter({tuple(r): 0 for r in some.tolist()}).keys() == {tuple(r) for r in rows.tolist()} and counts.sum() == 3 * n


def test_trie_sums_weights_from_given_starts():
    rng = np.random.default_rng(8)
    windows = rng.integers(0, 6, (400, 4))
    windows[np.arange(4) >= rng.integers(1, 5, 400)[:, None]] = -1
    weight = rng.integers(1, 9, 400)
    held = np.unique(windows[:150], axis=0)
    trie = DoubleArray(held, np.arange(len(held)))
    total = np.zeros(len(trie.check), np.int64)
    trie.walk(trie.codes_of(windows.ravel()), np.arange(0, 1600, 4), total, weight)
    got = {int(x): int(total[s]) for s, x in enumerate(trie.label) if x >= 0}
    assert got == {i: int(weight[((windows == h) | (h < 0)).all(1)].sum()) for i, h in enumerate(held)}


def test_scores_beyond_64_bits(spark):
    from nodehours.llm.phrases import _score
    big = [(10 ** 11, 10 ** 13, 2 * 10 ** 11, 3 * 10 ** 11), (7, 10 ** 15 + 1, 7, 9)]
    got = spark.createDataFrame(big, "a long, n long, l long, r long").select(_score()).collect()
    assert [r[0] for r in got] == [1000 * a * n // (x * y) for a, n, x, y in big]
