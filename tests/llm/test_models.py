"""Language model, classifiers, line dedup, decontamination and the pipeline against brute force or held-out labels."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nodehours.llm import decontaminate, lines, lm, quality, toxicity
from nodehours.llm.common import Folder
from nodehours.llm.queries import QUERIES
from tests.llm import cases


@pytest.fixture(scope="module")
def rows():
    return cases.awkward(cases.documents(200, "/root/testdata/sf0.001"))


def counts(rows, folds):
    one, two = Counter(), Counter()
    for i, t, *_ in rows:
        if cases.fold(i, 7) in folds:
            w = cases.words(t) + ["END"]
            one.update(w)
            two.update(zip(["START"] + w[:-1], w, strict=True))
            one["START"] += 1
    return one, two


def test_scores_equal_a_model_of_dictionaries(spark, rows):
    got = defaultdict(list)
    for r in lm.score(cases.frame(spark, rows)).collect():
        got[r.doc_id].append(r)
    one, two = counts(rows, {0, 1, 3, 4, 5, 6})
    learn1, learn2 = counts(rows, {0, 1, 4, 5, 6})
    starts = one["START"]
    n, v = sum(one.values()) - starts, len(one) - 1
    n_learn, v_learn = sum(learn1.values()) - learn1["START"], len(learn1) - 1
    octave = lambda c: 1 + int(math.log2(c)) if c else 0
    level = lambda p: round(-lm.STEPS * math.log2(p)) if p else -1
    cells = Counter()
    for i, t, *_ in rows:
        if cases.fold(i, 7) == 3:
            w = cases.words(t) + ["END"]
            for a, b in zip(["START"] + w[:-1], w, strict=True):
                cells[octave(learn1[a]), level(learn2[a, b] / max(learn1[a], 1)), level(learn1[b] / n_learn)] += 1
    mix = lm.weights([(*k, c) for k, c in sorted(cells.items())], v_learn)
    assert np.allclose(mix.sum(1), 1) and mix[0, 0] == 0
    for i, t, *_ in rows:
        w = cases.words(t) + ["END"]
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip(["START"] + w[:-1], w, strict=True):
            m = mix[octave(one[a])]
            score += math.log10(m[0] * two[a, b] / max(one[a], 1) + m[1] * one[b] / n + m[2] / (v + 1))
        known = sum(one[x] > 0 for x in w)
        assert any(r.n_tokens == len(w) and r.n_known == known and r.train_tokens == n and r.held_out == (cases.fold(i, 7) == 2)
                   and math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-6) for r in got[i]), i
    assert sum(map(len, got.values())) == len(rows)
    assert lm.score(cases.empty(spark)).count() == 0


def test_weights_find_the_better_estimate():
    w = lm.weights([(3, 2, 20, 100), (5, -1, 6, 100)], 1000)
    assert w[3, 0] > 0.95 and w[5, 1] > 0.9 and (w[4] == w[3]).all()


def naive_segments(scores):
    """Maximal scoring segments by their definition: best one, then the same left and right of it."""
    best = max(((sum(scores[a:z]), a, z) for a in range(len(scores)) for z in range(a + 1, len(scores) + 1)),
               key=lambda x: (x[0], x[1] - x[2]), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    _, a, z = best
    left, right = naive_segments(scores[:a]), naive_segments(scores[z:])
    return left + [best] + [(s, a2 + z, z2 + z) for s, a2, z2 in right]


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = rng.normal(-0.3, 1.0, rng.integers(1, 14)).round(3)
        total = np.cumsum(s)
        at = np.flatnonzero(s > 0).tolist()
        got = toxicity.segments((total - s)[at].tolist(), total[at].tolist(), at, at)
        want = naive_segments(s.tolist())
        assert [(a, z) for _, a, z in got] == [(a, z) for _, a, z in want]
        assert np.allclose([x for x, _, _ in got], [x for x, _, _ in want])


def test_toxicity_scores_by_definition(spark):
    rng, w = np.random.default_rng(5), (-1.5, 0.7, 1.1)
    model = toxicity.Model({"bad": 2.03, "worse": 3.57, "good": -1.01}, -0.21, 1.4, 0.02, w)
    said = ["bad", "worse", "good", "plain", "Bad!", "(WORSE)", "other"]
    texts = [" ".join(rng.choice(said, int(n), p=[.1, .05, .2, .4, .05, .05, .15])) for n in rng.integers(1, 60, 80)] + ["", None]

    rows = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, 0.5).collect()
    assert len(rows) == len(texts)
    for r in rows:
        s = [model.scores.get(x.strip("!()").lower(), model.other) for x in (texts[r.doc_id] or "").split()]
        found, n = naive_segments(s), max(len(s), 1)
        over = [max(0.0, 1.4 * x - math.log(0.02 * n)) for x, _, _ in found]
        p = 1 / (1 + math.exp(-(w[0] + w[1] * math.log1p(sum(over)) + w[2] * math.log1p(max(over, default=0.0)))))
        assert r.score == pytest.approx(p, abs=1e-9) and r.predicted == (r.score >= 0.5)
        told = [(a, z, x) for x, a, z in found if 0.02 * n * math.exp(-1.4 * x) <= toxicity.SIGNIFICANT]
        assert [(q["first"], q["end"]) for q in r.passages] == [(a, z) for a, z, _ in told]
        assert [q["score"] for q in r.passages] == pytest.approx([x for *_, x in told])


def test_decay_of_the_law():
    rng = np.random.default_rng(6)
    clean, toxic = rng.dirichlet(np.ones(50)), rng.dirichlet(np.ones(50))
    assert toxicity._decay(list(zip(clean, np.log(toxic / clean), strict=True))) == pytest.approx(1.0)
    assert toxicity._decay(list(zip(clean, 0.5 * np.log(toxic / clean), strict=True))) == pytest.approx(2.0)
    # no root: nothing positive, or positive on average
    assert toxicity._decay([(0.5, -1.0), (0.5, -2.0)]) == toxicity._decay([(0.5, 3.0), (0.5, -1.0)]) == 1.0


@pytest.mark.parametrize("name,label,modulus,held,most_wrong", [("op9_toxicity", "toxic", 5, 0, 0.08), ("op5_quality", "quality", 4, 2, 0.08)])
def test_held_out_accuracy(spark, name, label, modulus, held, most_wrong):
    d = "/root/testdata/sf0.1"
    out = QUERIES[name](spark, d)
    known = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", label)
    rows = out.where("held_out").join(known, "doc_id").where(F.col(label).isNotNull()).select("predicted", label).collect()
    assert sum(a != b for a, b in rows) <= most_wrong * len(rows)
    assert sum(a == b == (label == "toxic") for a, b in rows) >= 0.8 * sum(b == (label == "toxic") for _, b in rows)


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_classifiers_on_awkward_rows(spark, rows, run):
    labels = spark.createDataFrame([(r[0], i % 2, i % 2, 5) for i, r in enumerate(rows)] + [(None, 1, 1, 5), (3, None, None, 5), (3, 1, 1, 5)],
                                   "doc_id long, quality int, toxic int, text int")
    docs = cases.frame(spark, rows)
    got = run(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    nothing = run(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in nothing} == {0.5} and len(nothing) == len(rows)
    assert run(cases.empty(spark), labels).count() == 0


def plain(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def test_lines_equal_after_normalisation_are_dropped(spark, rows):
    passage = " ".join(f"word{i} of" for i in range(40))
    rows = [r for r in rows if r[0] is None or r[0] < 900_004] + [
        (950_001, f"Own line of this one document here\n{passage}\nshort", None, None, None),
        (950_002, f"{passage.upper()}!\nshort\nAnother line of quite its own words", None, None, None),
        (950_003, passage.replace("word20 ", "wxrd20 "), None, None, None)]
    df = cases.frame(spark, rows)
    out = lines.dedup_lines(df)
    assert out.columns == df.columns
    got = {(r.doc_id, r.th): r.text for r in out.collect()}
    assert len(out.collect()) == len(rows)
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[950_001] == rows[-3][1] and text[950_002] == "short\nAnother line of quite its own words"
    assert text[950_003] == "" and text[900_001] is None and text[900_002] == ""
    assert len(got) >= 1
    # every line that goes equals or resembles one that stays; no two equal long lines stay
    stay = Counter(plain(x) for r in out.collect() for x in (r.text or "").split("\n") if len(plain(x).split()) >= 5)
    assert max(stay.values()) == 1
    whole = {plain(x) for _, t, *_ in rows for x in (t or "").split("\n") if len(plain(x).split()) >= 5}
    gone = whole - set(stay)
    assert len(gone) <= 0.1 * len(whole)
    for x in gone:
        x = x.split()
        assert any(abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and near(x, y) >= 0.8 for y in map(str.split, stay)), x
    assert lines.dedup_lines(cases.empty(spark)).count() == 0


def near(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return 1 - row[-1] / max(len(x), len(y))


def test_pigeonhole_blocks_miss_no_pair(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-2**63, 2**63 - 1, 300)
    flips = [int(x) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, lines.RADIUS + 1), replace=False)) for x in base]
    for p in (4, 5, 6):
        df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(base, flips, strict=True)], "a long, b long")
        assert df.where(~F.arrays_overlap(lines.block_keys(F.col("a"), p), lines.block_keys(F.col("b"), p))).count() == 0


@pytest.mark.parametrize("p", [4, 5, 6, 7])
def test_lines_as_similar_as_asked_for_are_one_group_at_every_size(spark, monkeypatch, p):
    rng = np.random.default_rng(5)
    said = []
    for n in [5, 6, 7, 9, 10, 14, 19, 24, 40] * 4:
        base = [f"w{x}" for x in rng.integers(0, 900, n)]
        said.append(base)
        for _ in range(3):  # as far away as a similarity of 0.8 lets words be put in, left out or replaced
            line = list(base)
            for at in rng.choice(n - 1, n // 5, replace=False):
                line[at:at + 1] = [[f"x{rng.integers(900)}"], [], [line[at], f"x{rng.integers(900)}"]][rng.integers(3)] if n > 6 else [f"x{rng.integers(900)}"]
            said.append(line)
    said = [x for x in said if len(x) >= 5]
    first = list(range(len(said)))
    for i, x in enumerate(said):
        for j in range(i):
            if min(len(x), len(said[j])) >= 0.8 * max(len(x), len(said[j])) and set(x) & set(said[j]) and near(x, said[j]) >= 0.8:
                a, b = sorted((first[i], first[j]))
                first = [a if f == b else f for f in first]
    monkeypatch.setattr(lines, "pieces", lambda n: p)  # as a table of that many lines has it
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(said)], "doc_id long, text string")
    gone = lines.repeated_lines(docs, Folder(spark, "recall"))
    assert {r.doc_id for r in gone.collect()} == {i for i, f in enumerate(first) if f != i}


def test_lines_of_few_words_and_of_scripts_without_spaces_are_dropped(spark):
    said = ["All rights reserved", "版权所有不得转载", "所有权利由作者保留，未经许可不得转载本文的任何部分", "Yes, no"]
    near_one = said[2].replace("本文", "此文")
    docs = spark.createDataFrame([(1, "\n".join([*said, ""])), (2, "\n".join(["all rights  reserved.", *said[1:], ""])), (3, near_one)],
                                 "doc_id long, text string")
    text = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert text == {1: "\n".join([*said, ""]), 2: "Yes, no\n", 3: ""}


def test_simhash_is_the_majority_of_bits(spark, monkeypatch):
    rows = [(n, n, "\n".join(["Head of it", " ".join(f"w{i * i}" for i in range(n))])) for n in (1, 2, 63, 64, 127, 300, 4000)]
    df = spark.createDataFrame(rows, "doc_id long, th long, text string")
    usual = {(r.doc_id, r.pos): (r.lh, r.len, r.sim) for r in lines.fingerprinted(df).collect()}
    monkeypatch.setattr(lines, "MOST_CHARS", 100)  # longer ones as arrays
    assert {(r.doc_id, r.pos): (r.lh, r.len, r.sim) for r in lines.fingerprinted(df).collect()} == usual and len(usual) == 14
    for n, _, text in rows:
        w = text.split("\n")[1].split()
        h = [r.h for r in spark.createDataFrame([(x,) for x in w], "w string").select(F.xxhash64("w").alias("h")).collect()]
        heavy = [max(1, len(x) - 2) for x in w]
        want = sum(1 << b for b in range(64) if 2 * sum(k * ((x >> b) & 1) for x, k in zip(h, heavy, strict=True)) > sum(heavy))
        assert usual[n, 1][1] == n and usual[n, 1][2] % (1 << 64) == want


def test_benchmark_items_are_found(spark, rows):
    rng = np.random.default_rng(8)
    items = [(i, " ".join(f"item{i}w{k}" for k in range(n))) for i, n in enumerate([3, 6, 12, 20, 41, 60, 150])] + [(90, None), (91, ""), (92, "...")]
    docs = [r for r in rows if r[0] is None or r[0] < 900_004]
    for i, t in items[:7]:
        w = docs[i][1].split()
        at = int(rng.integers(len(w) + 1))
        docs.append((970_000 + i, " ".join([*w[:at], t.upper() + ",", *w[at:]]), None, None, None))
    w = items[5][1].split()
    docs.append((970_100, "x y z " + " ".join([*w[:1], "edit", *w[2:]]) + " tail", None, None, None))
    docs.append((970_101, "half of it: " + " ".join(items[5][1].split()[:30]), None, None, None))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(cases.frame(spark, docs), bench).collect()}
    assert set(got) == {(970_000 + i, i) for i in range(7)} | {(970_100, 5)}
    assert all(s == 1.0 for (d, _), s in got.items() if d < 970_100)
    assert decontaminate.contaminated(cases.empty(spark), bench).count() == 0
    assert decontaminate.contaminated(cases.frame(spark, docs), bench.limit(0)).count() == 0


def test_benchmark_in_several_passes(spark, rows, monkeypatch):
    docs, bench = spark.read.parquet(f"{cases.SF}/documents.parquet"), spark.read.parquet(f"{cases.SF}/benchmark.parquet")
    whole = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "PART_BYTES", 15_000)
    assert len(whole) > 3 and {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()} == whole
    # brute force: the share of an item's shingles anywhere in the document
    texts = {r.doc_id: shingled(r.text) for r in docs.collect()}
    for b in bench.collect():
        item = shingled(b.text)
        for i, have in texts.items():
            if sum(len("".join(s)) * min(c, have[s]) for s, c in item.items()) >= 0.999 * sum(len("".join(s)) * c for s, c in item.items()):
                assert any((i, b.item_id) == x[:2] for x in whole)


def shingled(text):
    w = [x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or x for x in cases.words(text)]
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def test_candidates_are_all_pairs_within_the_radius():
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 2**63, 40).astype(np.uint64)
    windows = np.array([p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 12), replace=False))) for p in prints for _ in range(20)])
    table = decontaminate.Index._tables([(0, prints)])
    w, f = decontaminate._candidates(table, windows)
    want = {(i, j) for i, x in enumerate(windows) for j, y in enumerate(prints) if int(x ^ y).bit_count() <= decontaminate.RADIUS}
    assert set(zip(w.tolist(), f.tolist(), strict=True)) == want


def test_pipeline_stages(spark):
    d = cases.SF
    docs = before = spark.read.parquet(f"{d}/documents.parquet")
    folder = Folder(spark, "test")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = folder.put(stage(spark, docs, d), f"s{k}")
        assert docs.columns == before.columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    bad = {r.doc_id for r in before.collect() if re.search("trash|pathetic|idiot|worthless|clown|moron|disgusting|loser|scum|stupid", r.text or "")}
    assert len(bad & set(kept[0])) <= 0.2 * len(bad) and len(kept[0]) >= 0.85 * before.count()
    assert set(kept[1]) == set(kept[0])
    left = {i: cases.words(t) for i, t in kept[2].items()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for i, w in left.items()}
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j > i}:
            assert len(s & sets[j]) < 0.8 * len(s | sets[j])
    assert len(kept[3]) < len(kept[2])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {p.doc_id for p in pieces} == set(kept[3])
    whole = Counter(corpus_pipeline.run(spark, d).select("doc_id", "start", "length", "ids_crc32").collect())
    assert whole == Counter((p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces)
    assert zlib.crc32(b"") == 0


def test_shingles_of_arrow_texts_keep_their_places():
    text = pa.array(["A b  c", None, "", " x"])
    from nodehours.llm.words import words
    offsets, codes, vocabulary = words(text)
    assert offsets.tolist() == [0, 3, 3, 3, 4] and [vocabulary[c] for c in codes] == ["a", "b", "c", "x"]


def test_pipeline_on_awkward_rows_and_no_rows(spark, rows):
    for docs in (cases.frame(spark, rows), cases.empty(spark)):
        many, folder = docs.count() > 0, Folder(spark, "awkward")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            before, docs = docs, folder.put(stage(spark, docs, cases.SF), f"s{k}")
            assert docs.columns == before.columns and (docs.count() > 0) == many
        ids = {r.doc_id for r in docs.collect()}
        assert not many or ids >= {None, 900_001, 900_002, 900_003, 900_004, 900_006, 900_007}
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, cases.SF).collect()
        assert {p.doc_id for p in pieces} == ids


def test_template_lines_repeat_nothing_and_make_few_pairs(spark, monkeypatch):
    made = []
    verified = lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *a: made.append(pairs.count()) or verified(pairs, *a))
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("concat('w', id, ' x', id * 7, ' added to the shopping cart by user')").alias("text"))
    # among them, a line that differs in one word is found by the word it shares
    docs = docs.unionByName(spark.createDataFrame([(n, "w5 y added to the shopping cart by user")], "doc_id long, text string"))
    assert [r.doc_id for r in lines.dedup_lines(docs).where("text = ''").collect()] == [n]
    assert sum(made) < 10 * n


def test_words_whose_codes_fall_together_are_told_apart(spark):
    from itertools import combinations
    codes = {}
    for r in spark.range(4000).select(F.concat(F.lit("w"), "id").alias("w")).select("w", F.xxhash64("w").bitwiseAND(0xFFFFF).alias("c")).collect():
        codes.setdefault(r.c, []).append(r.w)
    x, y = next(p for ws in codes.values() for p in combinations(ws, 2))
    said = [f"{x} a1 a2 a3 a4 a5 b1 b2", f"{y} a1 a2 a3 a4 a5 b1 b3", f"{y} a1 a2 a3 a4 a5 b1 b2"]  # 2, 1 and 1 words of 8 apart
    words = spark.createDataFrame([(i, s.split()) for i, s in enumerate(said)], "lh long, ws array<string>").select("lh", F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "a long, b long")
    assert {tuple(r) for r in lines._verified(pairs, words, 0.8, Folder(spark, "codes"), "close").collect()} == {(1, 2), (0, 2)}


def test_pipeline_decides_by_id_and_text(spark, tmp_path):
    import corpus_pipeline
    item = " ".join(f"benchmark word number {i} of this very item" for i in range(12))
    long = " ".join(f"some{i} other{i} words" for i in range(60))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, f"before it {item} after it"), (1, item), (1, "a clean text under the same id"), (2, long), (2, long), (None, long + " more"),
                                  (3, "clean and alone"), (None, None)], "doc_id long, text string")
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in clean) == Counter([1, 2, None, 3, None]) and not any("benchmark" in (r.text or "") for r in clean)
    one = corpus_pipeline.jaccard_join(spark, docs.where("doc_id = 2 OR doc_id IS NULL OR doc_id = 3"), str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in one) == Counter([(2, long), (3, "clean and alone"), (None, None), (None, f"before it {item} after it")])


def test_word_pairs_of_every_text_are_counted(spark):
    n = 45_000  # more than were looked at once
    docs = spark.range(n).select(F.concat(F.lit("first second\nthe only number"), "id").alias("text"))
    table = lines.rarity(docs)
    two = [r.b for r in spark.createDataFrame([("first", "second"), ("the", "only")], "x string, y string").select(
        F.pmod(F.xxhash64("x", "y"), F.lit(lines.BUCKETS)).alias("b")).collect()]
    assert [table[b] - 33 for b in two] == [int(2 * math.log2(n + 1))] * 2
    assert sum(v > 33 for v in table) > 0.9 * lines.BUCKETS * (1 - math.exp(-n / lines.BUCKETS))


def test_pairs_of_a_group_are_looked_at_where_they_are_made(spark):
    # 40 lines share a key; only two of them are near, and no other pair may leave the join
    rows = [(i, 8, (i * 0x9E3779B97F4A7C15) % (1 << 63), [77]) for i in range(1, 40)] + [(40, 8, 0x9E3779B97F4A7C15 % (1 << 63) ^ 5, [77])]
    keyed = spark.createDataFrame(rows, "lh long, len int, sim long, keys array<long>")
    pairs, many = lines._candidates(keyed, Folder(spark, "near"), "pairs", lines._like(0.8, 8))
    sim = {r[0]: r[2] for r in rows}
    want = {(a, b) for a in sim for b in sim if a < b and (sim[a] ^ sim[b]).bit_count() <= 8}
    assert {tuple(r) for r in pairs.collect()} == want and (1, 40) in want and len(want) < 60 and many.count() == 0


def test_a_line_is_hashed_once_and_not_for_each_word(spark):
    rows = spark.createDataFrame([(1, "a b c a")], "doc_id long, line string")
    turns = lines._in_turn(rows, "doc_id")
    plan = turns._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda s: next(i for i, x in enumerate(plan) if s in x)
    assert at("xxhash64(words") > at("Generate posexplode")  # below it
    assert [(r.w, r.next) for r in turns.collect()] == [("a", "b"), ("b", "c"), ("c", "a"), ("a", None)]


def test_candidates_of_all_slices_and_words_of_repeated_rows(spark):
    folder, width = Folder(spark, "slices"), 2 * lines.SLICE + 1
    keyed = spark.createDataFrame([(2 * k + i, 8, k, [100 * k + (j if j == k else 10_000 * (2 * k + i + 1) + j) for j in range(width)]) for k in range(width) for i in (0, 1)],
                                  "lh long, len int, sim long, keys array<long>")
    pairs, many = lines._candidates(keyed, folder, "blocks", lines._like(0.8, 8), width)
    assert {tuple(r) for r in pairs.collect()} == {(2 * k, 2 * k + 1) for k in range(width)} and many.count() == 0
    text = spark.createDataFrame([(1, "x\none two\nthree"), (1, "x\none two\nthree"), (None, "one two")], "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    at = text.dropDuplicates().select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("lh", F.xxhash64("line"))
    found = lines._words_of(at.where("line <> 'x'").select("lh").distinct(), at, text, folder, "words")
    want = at.where("line <> 'x'").select("lh", F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("hs")).distinct()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def _numbered_lines(spark, said):
    df = spark.createDataFrame([(i, i, " ".join(x)) for i, x in enumerate(said)], "doc_id long, th long, text string")
    rows = lines.fingerprinted(df)
    return {r.doc_id: r.lh for r in rows.select("doc_id", "lh").collect()}, rows


def test_parity_of_words_loses_no_near_line_and_drops_others(spark):
    rng = np.random.default_rng(8)
    said, want = [], set()
    for n in [5, 7, 10, 19, 40, 100] * 5:
        base = [f"w{x}" for x in rng.integers(0, 900, n)]
        other = list(base)
        for at in sorted(rng.choice(n - 1, n // 5, replace=False), reverse=True):
            other[at:at + 1] = [[f"x{rng.integers(900)}"], [], [other[at], f"x{rng.integers(900)}"]][rng.integers(3)]
        if near(base, other) >= 0.8:
            want.add((len(said), len(said) + 1))
        said += [base, other]
    lh, rows = _numbered_lines(spark, said)
    pairs = [(lh[i], lh[j], 64) for i in range(len(said)) for j in range(i) if lh[i] != lh[j]]
    got = {tuple(sorted(r)) for r in lines._alike(spark.createDataFrame(pairs, "a long, b long, bits int"), rows, 0.8).collect()}
    assert len(want) > 10 and {tuple(sorted((lh[i], lh[j]))) for i, j in want} <= got
    assert len(got) < 0.1 * sum(min(len(said[i]), len(said[j])) >= 0.8 * max(len(said[i]), len(said[j])) for i in range(len(said)) for j in range(i))


@pytest.mark.parametrize("crowd", [4096, 50])
def test_words_of_lines_that_share_a_common_pair_only_are_not_fetched(spark, monkeypatch, crowd):
    rng = np.random.default_rng(9)
    # each bin's rarest pair is one of few, so that unlike lines share keys and groups are large
    monkeypatch.setattr(lines, "rarity", lambda text: None)
    monkeypatch.setattr(lines, "CROWD", crowd)
    fetched, words_of = [], lines._words_of
    monkeypatch.setattr(lines, "_words_of", lambda wanted, *a: fetched.append((a[-1], wanted.count())) or words_of(wanted, *a))
    said = [[f"v{x}" for x in rng.integers(0, 3, 16)] + [f"r{i}y{k}" for k in range(40)] for i in range(400)]
    said += [[*said[7][:-1], "z"], [*said[300][:-2], "z", "z"]]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(said)], "doc_id long, text string")
    assert {r.doc_id for r in lines.repeated_lines(docs, Folder(spark, "common")).collect()} == {400, 401}
    assert all(n < 40 for name, n in fetched if name != "said") and (crowd == 50) == ("said" in dict(fetched))


def _levels(spark, table):
    return spark.createDataFrame([(table,)], "levels binary")


def test_counts_of_word_pairs_are_not_written_into_plans(spark):
    text = spark.createDataFrame([(1, 1, "one two three four five\none two three")], "doc_id long, th long, text string")
    rows = lines.fingerprinted(text, _levels(spark, lines.rarity(text)))
    plan = rows._jdf.queryExecution().toString()
    assert len(plan) < lines.BUCKETS
    # a line's sums are as wide as several lines: texts move, once, and sums stay where they are made
    assert [x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange " in x and "hashpartitioning(doc_id" not in x] == []
    assert "pos" not in "".join(x for x in plan.splitlines() if " Exchange " in x)
    first, second = (set(r[k] for k in range(len(r)) if r[k] is not None) for r in rows.orderBy("pos").select(*[f"k{b}" for b in range(lines.BINS)]).collect())
    assert second <= first and len(first) == 4 and {k >> 56 for k in second} == {33 + 3} and {k >> 56 for k in first} == {33 + 3, 33 + 2}


def test_groups_of_rare_keys_move_once_and_give_no_unlike_pair(spark):
    rng = np.random.default_rng(10)
    rows = []  # groups of 2, 3, 40 and 100 lines; in each two are near, two more by fingerprint but not by words
    for key, n in ((34, 2), (40, 3), (50, 40), (67, 100)):
        group = [[1000 * key + i, 8, int(rng.integers(1 << 62)), int(rng.integers(1 << 31)), [key << 56 | 7]] for i in range(n)]
        group[-1][2:4] = [group[0][2] ^ 5, group[0][3] ^ 3]
        if n > 3:
            group[-2][2:4] = [group[1][2] ^ 5, group[1][3] ^ 0x7FFFFFFF]
        rows += group
    rows.append([1, 8, 1, 1, [35 << 56 | 9]])
    keyed = spark.createDataFrame(rows, "lh long, len int, sim long, odd int, keys array<long>")
    folder, made, put = Folder(spark, "rare"), [], Folder.put
    folder.put = lambda df, name: made.append((name, df._jdf.queryExecution().executedPlan().toString().count(" Exchange "))) or put(folder, df, name)
    pairs, many = lines._candidates(keyed, folder, "pairs", lines._like(0.8, 8), ranked=lines._few_flips(0.8, ["odd"]))
    near_ = {(34_000, 34_001), (40_000, 40_002), (50_000, 50_039)}
    assert {tuple(r) for r in pairs.collect()} == near_ | {(67_000, 67_099)}
    assert {tuple(r) for r in many.collect()} == {((67 << 56 | 7), 67_000, 67_000 + i) for i in range(100)}
    assert dict(made)["pairs_rare/part0"] == 1


def test_folded_parity_loses_no_near_line(spark):
    rng = np.random.default_rng(11)
    said = []
    for n in [5, 9, 20, 40] * 10:
        base = [f"w{x}" for x in rng.integers(0, 900, n)]
        other = list(base)
        for at in sorted(rng.choice(n - 1, n // 5, replace=False), reverse=True):
            other[at:at + 1] = [[f"x{rng.integers(900)}"], [], [other[at], f"x{rng.integers(900)}"]][rng.integers(3)]
        said += [base, other]
    _, rows = _numbered_lines(spark, said)
    side = lambda x, r: rows.where(f"doc_id % 2 = {r}").select(F.floor(F.col("doc_id") / 2).alias("i"), F.col("len").alias(f"{x}_len"), lines._folded().alias(f"{x}_odd"))
    near_ = [i for i in range(len(said) // 2) if near(said[2 * i], said[2 * i + 1]) >= 0.8]
    got = {r.i for r in side("a", 0).join(side("b", 1), "i").where(lines._few_flips(0.8, ["odd"])).collect()}
    assert len(near_) > 20 and set(near_) <= got
