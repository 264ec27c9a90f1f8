"""Benchmark items inside documents, found by fingerprints of item-sized windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodehours.llm.common import body
from nodehours.llm.words import MIX, hashes, mixed, sliced, stripped, words

RADIUS = 7  # bits of 64 in which fingerprints may differ
BLOCKS = 4  # blocks of 16 bits; within RADIUS, some block differs in at most RADIUS // BLOCKS = 1 bit
PART_BYTES = 16 << 20  # item text searched for in one pass over the documents; more items take more passes
GROWTH = 1.25  # from one window size to the next
SHARE = 0.8  # a window is at most this share of its item
FILTER_BITS = 20  # of a shingle's hash that tell at once that most stretches hold no shingle of an item
RUNNING_WORDS = 100_000  # words whose sums of bits are held at a time, about
MARGIN = 4  # a verified stretch reaches 1 / MARGIN of the item beyond it on either side


def window_sizes(longest: int) -> list[int]:
    """Window sizes in words up to a length."""
    out = [1]
    while out[-1] <= longest:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


def stride(size: int) -> int:
    """Words from one window to the next: some window lies wholly inside any copy of an item of the class."""
    return max(1, size // 4)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)


def fingerprints(running: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of size words that start at some places; running holds the sums of word bits before each place."""
    count = running[at + size] - running[at]
    if count.dtype == np.uint64:
        count = count.view(np.uint8)
    return np.packbits(count > size // 2, axis=1).view(np.uint64).ravel()


def _running(bits: np.ndarray, codes: np.ndarray, wide: bool) -> np.ndarray:
    """Sums of bits before each word.

    Unless wide, eight sums share a 64-bit number, a byte each: differences over up to 255 words are exact, whatever
    has been carried from byte to byte before.
    """
    bits = bits.astype(np.int32) if wide else bits.view(np.uint64)
    out = np.zeros((len(codes) + 1, bits.shape[1]), bits.dtype)
    if len(codes):
        np.cumsum(bits[codes], axis=0, out=out[1:])
    return out


def _shingles(codes: np.ndarray, h: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight (characters of its words) of each run of width words; a shorter text is one run."""
    width = max(1, min(width, len(codes)))
    key, weight = h[codes].copy(), size[codes].astype(np.int64)
    of = weight.copy()
    n = len(codes) - width + 1
    for k in range(1, width):
        key[:n] = mixed(key[:n] * MIX + h[codes[k:k + n]])
        of[:n] += weight[k:k + n]
    return key[:n], of[:n]


@dataclass
class Item:
    """Distinct shingles of an item, how often they occur and what they weigh."""

    words: int
    keys: np.ndarray
    counts: np.ndarray
    weights: np.ndarray
    run: int  # words of a shingle


@dataclass
class Tables:
    """Fingerprints of one window size, and for each block value those that have it within one bit."""

    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    starts: list[np.ndarray]
    lists: list[np.ndarray]


class Index:
    """Items of a benchmark by the fingerprints of all their windows."""

    def __init__(self, texts: list[str], width: int) -> None:
        offsets, codes, vocabulary = stripped(*words(pa.array(texts, pa.string())))
        h = hashes(vocabulary)
        bits, size = _bits(h), np.array([len(w) for w in vocabulary], np.int64)
        self.words = length = np.diff(offsets)
        sizes = window_sizes(int(length.max(initial=0)))
        self.items: list[Item | None] = []
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, (lo, n) in enumerate(zip(offsets[:-1].tolist(), length.tolist(), strict=True)):
            if not n:
                self.items.append(None)
                continue
            own = codes[lo:lo + n]
            key, weight = _shingles(own, h, size, width)
            keys, first, counts = np.unique(key, return_index=True, return_counts=True)
            self.items.append(Item(n, keys, counts, weight[first], min(width, n)))
            window = max(s for s in sizes if s <= max(1, SHARE * n))
            by.setdefault(window, []).append((i, fingerprints(_running(bits, own, window > 255), np.arange(n - window + 1), window)))
        self.tables = {w: self._tables(x) for w, x in by.items()}
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        for x in self.items:
            if x is not None:
                self.filter[x.keys >> np.uint64(64 - FILTER_BITS)] = True

    @staticmethod
    def _tables(found: list[tuple[int, np.ndarray]]) -> Tables:
        prints = np.concatenate([p for _, p in found])
        item = np.repeat([i for i, _ in found], [len(p) for _, p in found])
        offset = np.concatenate([np.arange(len(p)) for _, p in found])
        flips = np.array([0] + [1 << b for b in range(16)], np.uint16)
        starts, lists = [], []
        for block in prints.view(np.uint16).reshape(-1, BLOCKS).T:
            value = (block[:, None] ^ flips).ravel()
            order = np.argsort(value, kind="stable")
            starts.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << 16))]))
            lists.append((order // len(flips)).astype(np.int32))
        return Tables(prints, item, offset, starts, lists)


def _candidates(table: Tables, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows and fingerprints of the table within RADIUS of each other; every such pair is found."""
    windows, found = [], []
    for block, starts, lists in zip(prints.view(np.uint16).reshape(-1, BLOCKS).T, table.starts, table.lists, strict=True):
        lo = starts[block]
        n = starts[block.astype(np.int64) + 1] - lo
        some = np.flatnonzero(n)
        lo, n = lo[some], n[some]
        w = np.repeat(some, n)
        f = lists[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(some) else np.zeros(0, np.int32)
        near = np.bitwise_count(prints[w] ^ table.prints[f]) <= RADIUS
        windows.append(w[near])
        found.append(f[near])
    return np.concatenate(windows), np.concatenate(found)


def _found(texts: pa.Array, index: Index, width: int, least: float) -> list[tuple[int, int, float]]:
    offsets, codes, vocabulary = stripped(*words(texts))
    h = hashes(vocabulary)
    bits, size = _bits(h), np.array([len(w) for w in vocabulary], np.int64)
    # shingles that may be an item's, summed up to each word: a stretch without any cannot be similar
    keys, _ = _shingles(codes, h, size, width)
    maybe = np.concatenate([[0], np.cumsum(index.filter[keys >> np.uint64(64 - FILTER_BITS)])])
    out, lo, n = [], 0, len(texts)
    while lo < n:  # sums of bits for some texts at a time
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + RUNNING_WORDS, "right")) - 1)
        out += _verified(index, offsets[lo:hi + 1], codes, h, bits, size, keys, maybe, width, least, lo)
        lo = hi
    return out


def _verified(index: Index, offsets: np.ndarray, codes: np.ndarray, h: np.ndarray, bits: np.ndarray, size: np.ndarray,
              keys: np.ndarray, maybe: np.ndarray, width: int, least: float, first: int) -> list[tuple[int, int, float]]:
    base, n = offsets[0], np.diff(offsets)
    local = codes[base:offsets[-1]]
    place = np.arange(len(local)) - np.repeat(offsets[:-1] - base, n)
    left = np.repeat(n, n) - place
    running = _running(bits, local, max(index.tables, default=0) > 255)
    found = []
    for window, table in index.tables.items():
        at = np.flatnonzero((place % stride(window) == 0) & (left >= window))
        w, f = _candidates(table, fingerprints(running, at, window))
        # the stretch around the place where the item would begin
        item, begin = table.item[f], at[w] - table.offset[f]
        text = np.searchsorted(offsets - base, at[w], "right") - 1
        reach, long = index.words[item] // MARGIN, index.words[item]
        lo, hi = np.maximum(begin - reach, offsets[text] - base), np.minimum(begin + long + reach, offsets[text + 1] - base)
        run = np.minimum(long, width)
        last = np.minimum(base + hi - run + 1, len(maybe) - 1)
        ok = (hi - lo >= run) & ((run < width) | (maybe[np.maximum(last, base + lo)] > maybe[base + lo]))
        found.append(np.column_stack([text[ok], item[ok], lo[ok], hi[ok]]))
    best: dict[tuple[int, int], float] = {}
    for t, i, lo, hi in np.unique(np.concatenate(found), axis=0).tolist() if found else ():
        item = index.items[i]
        own = keys[base + lo:base + hi - width + 1] if item.run == width else _shingles(local[lo:hi], h, size, item.run)[0]
        have, times = np.unique(own, return_counts=True)
        at = np.minimum(np.searchsorted(have, item.keys), len(have) - 1)
        shared = np.where(have[at] == item.keys, np.minimum(times[at], item.counts), 0)
        alike = float(shared @ item.weights / (item.counts @ item.weights))
        if alike >= least:
            best[t, i] = max(alike, best.get((t, i), 0.0))
    return [(first + t, i, s) for (t, i), s in best.items()]


def search(texts: pa.Array, index: Index, width: int, least: float) -> list[tuple[int, int, float]]:
    """(text, item, similarity) of every verified item, the best place of each."""
    return _found(texts, index, width, least) if len(texts) and index.tables else []


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """Benchmark items that occur in documents.

    Texts are lower-cased, words freed of punctuation. For each item, a window of at most SHARE of its words is slid over
    the item, and one of the same size over every document in steps of a quarter. SimHash
    fingerprints of the two are matched through 16-bit blocks: of two within RADIUS bits, one block differs in
    at most one bit, and tables list the fingerprints within one bit of each block value, so none is missed. Around each match the
    exact similarity is taken: the share of the item's shingles (width words, weighted by their characters, each as
    often as it occurs) that the stretch of the document holds. Items enter as literals; beyond PART_BYTES of
    them the documents are read once more for each further part.

    Returns one row per document row and item with similarity of at least `least`: doc_id, item_id, similarity. Documents
    without one have no row. Null texts are empty; empty items are in nothing; an item shorter than width words is one shingle.
    Repeated items and rows are matched each. Empty tables give no rows. Other columns are ignored.
    """
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    items = benchmark.select("item_id", body().alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + size // PART_BYTES
    part = F.pmod(F.xxhash64("text"), F.lit(count))
    text = docs.select("doc_id", body().alias("text"))
    out = None
    for k in range(count):
        rows = items.where(part == k).collect()  # about PART_BYTES of text
        index, ids = Index([r.text for r in rows], width), pa.array([r.item_id for r in rows])

        def run(batches: Iterator[pa.RecordBatch], index: Index = index, ids: pa.Array = ids) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                found = search(b["text"], index, width, least)
                yield pa.record_batch({"doc_id": b["doc_id"].take(pa.array([t for t, _, _ in found], pa.int64())),
                                       "item_id": ids.take(pa.array([i for _, i, _ in found], pa.int64())),
                                       "similarity": pa.array([s for _, _, s in found], pa.float64())})

        found = text.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, similarity double")
        out = found if out is None else out.unionByName(found)
    return out
