"""Shared parts: block exchange of counts, components, words."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nodehours.llm import tally
from nodehours.llm.common import Folder, checked
from nodehours.llm.components import components
from nodehours.llm.words import hashes, sliced, stripped, words
from tests.llm import cases


def test_sorted_keys_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (tally.got_sorted(tally.put_sorted(keys)) == keys).all()


def test_every_block_learns_the_counts_of_all(spark, monkeypatch):
    rows = cases.awkward(cases.documents(100, "/root/testdata/sf0.001"))
    df = spark.createDataFrame([(i, t or "", k % 3) for k, (i, t, *_) in enumerate(rows)], "doc_id long, text string, part int").repartition(4)
    folder = Folder(spark, "tally")
    blocks = tally.encoded(df.withColumn("mark", F.lit(0)), folder)

    def asks(b):
        key, n = np.unique(b.vocabulary[b.codes], return_counts=True)
        return [(key, n)]

    answers = tally.counted(blocks, asks, [5], lambda sums, parts: (np.stack([sums.sum(0), sums[parts == 1].sum(0)]).astype("<u8"), [int(sums.sum())]), folder)
    want, ones = Counter(), Counter()
    for k, (_, t, *_) in enumerate(rows):
        want.update(cases.words(t))
        ones.update(cases.words(t) if k % 3 == 1 else [])
    of = {int(h): w for w, h in zip(want, hashes(list(want)), strict=True)}
    replies = answers.where("block >= 0").collect()
    for row in blocks.collect():
        b = tally.Block(row.asDict())
        mine = pa.table({"bucket": [r.bucket for r in replies if r.block == b.block], "counts": [bytes(r.counts) for r in replies if r.block == b.block]})
        got = tally.answers_of(mine, 0, 5, "<u8", 2)
        keys = asks(b)[0][0]
        assert got.shape == (2, len(keys))
        for key, all_, one in zip(keys.tolist(), *got.tolist(), strict=True):
            assert (all_, one) == (want[of[key]], ones[of[key]])
    assert answers.where("block < 0").agg(F.sum(F.col("stats")[0])).first()[0] == sum(want.values())
    assert sum(r.n_words for r in blocks.select("n_words").collect()) == sum(want.values())


def test_components_of_chains_stars_and_repeats(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 3), (3, 7), (7, 7)]
    links += [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (120, 2))]
    want = cases.components({x for e in links for x in e}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b", Folder(spark, "c")).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and set(want) - set(got) <= {a for a, b in links if a == b}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b", Folder(spark, "c")).count() == 0


def test_words_and_batches():
    texts = pa.array(["\x0b\x0cA b  C\n", None, "", "x" * 50, "é É"])
    offsets, codes, vocabulary = words(texts)
    assert [[vocabulary[c] for c in codes[a:z]] for a, z in zip(offsets[:-1], offsets[1:], strict=True)] == [["a b", "c"], [], [], ["x" * 50], ["é", "É"]]
    _, codes, vocabulary = stripped(*words(pa.array(["(a) a! ... b-c"])))
    assert [vocabulary[c] for c in codes] == ["a", "a", "...", "b-c"]
    batch = pa.record_batch({"text": pa.array(["a" * n for n in (5, 0, 30, 2, 2, 2)])})
    parts = list(sliced([batch], most_bytes=8))
    assert [p.num_rows for p in parts] == [2, 1, 3] and pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()


def test_a_side_too_large_is_not_broadcast(spark):
    side = spark.range(100)
    hinted = lambda n: "broadcast" in checked(side, n)._jdf.queryExecution().logical().toString()
    assert hinted(100) and not hinted(99)
