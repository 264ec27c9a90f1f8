"""Corpus-wide counts of word keys, exchanged in blocks.

A block is some megabytes of consecutive texts, encoded as numbers into its own vocabulary and written
once. Each block asks for the corpus counts of its distinct keys: sorted and split by key range, they go to one bucket
each; the bucket adds up what all blocks report and answers every block in the order of its keys. A key that is in a
third of all texts costs one entry per block, never one per text, so no key makes a bucket large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from nodehours.llm.common import Folder
from nodehours.llm.words import hashes, sliced, words

BLOCK_BYTES = 8 << 20  # text of a block
BUCKET_KEYS = 1_000_000  # keys a bucket holds, about, whatever the size of the corpus


# ------------------------------------------------------------------ arrays as bytes


def put(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def got(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def put_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte planes apart, so that leading zeros take no room."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return put(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def got_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(got(b, "u1").reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


# ------------------------------------------------------------------ blocks


BLOCK = "block long, part int, ids array<{kind}>, marks binary, offsets binary, codes binary, vocabulary binary, n_words long"


def _encoded(block: int, part: int, rows: pa.Table) -> pa.RecordBatch:
    text, ids = rows["text"].combine_chunks(), rows["doc_id"].combine_chunks()
    offsets, codes, vocabulary = words(text)
    binary = lambda a: pa.array([put(a)], pa.binary())
    return pa.record_batch({
        "block": pa.array([block], pa.int64()), "part": pa.array([part], pa.int32()),
        "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        "marks": binary(rows["mark"].to_numpy().astype("<i4")), "offsets": binary(offsets.astype("<i8")),
        "codes": binary(codes.astype("<i4")), "vocabulary": binary(hashes(vocabulary).astype("<u8")),
        "n_words": pa.array([len(codes)], pa.int64())})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive texts in blocks; each part of the corpus has blocks of its own."""
    at = TaskContext.get().partitionId() << 32
    waiting: dict[int, list[pa.RecordBatch]] = {}
    size: dict[int, int] = {}
    for batch in sliced(batches, most_bytes=BLOCK_BYTES // 4):
        parts = np.asarray(batch["part"])
        for part in np.unique(parts).tolist():
            rows = batch.filter(pa.array(parts == part))
            waiting.setdefault(part, []).append(rows)
            size[part] = size.get(part, 0) + rows["text"].nbytes
            if size[part] >= BLOCK_BYTES:
                yield _encoded(at, part, pa.Table.from_batches(waiting.pop(part)))
                at, size[part] = at + 1, 0
    for part, rows in waiting.items():
        yield _encoded(at, part, pa.Table.from_batches(rows))
        at += 1


def encoded(texts: DataFrame, folder: Folder, name: str = "blocks") -> DataFrame:
    """Blocks of texts (doc_id, text, part, mark) as a written table; words are lower-cased (A-Z)."""
    kind = dict(texts.dtypes)["doc_id"]
    rows = texts.select("doc_id", "text", F.col("part").cast("int"), F.col("mark").cast("int"))
    return folder.put(rows.mapInArrow(_cut, BLOCK.format(kind=kind)), name)


class Block:
    """A block read back: words of its texts as numbers into the hashes of its vocabulary."""

    def __init__(self, row: dict) -> None:
        self.block, self.part, self.ids = row["block"], row["part"], row["ids"]
        self.marks, self.offsets = got(row["marks"], "<i4"), got(row["offsets"], "<i8")
        self.codes, self.vocabulary = got(row["codes"], "<i4"), got(row["vocabulary"], "<u8")


# ------------------------------------------------------------------ exchange


ASK = "bucket long, block long, part int, keys binary, n binary"
ANSWER = "block long, part int, bucket long, counts binary, stats array<long>"


def counted(blocks: DataFrame, asks: Callable[[Block], list[tuple[np.ndarray, np.ndarray]]], buckets: list[int],
            answer: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list[int]]], folder: Folder, name: str = "answers") -> DataFrame:
    """Corpus counts of every block's keys as a written table.

    asks gives, for each kind of key, the sorted distinct keys of a block and the block's own counts; buckets the number of
    buckets of each kind, which are numbered one kind after the other. A bucket sums counts over all blocks
    and over each part; answer turns the sums of its keys (a row for each part present, and their
    numbers) into what each key is answered with, and into figures of the bucket. The rows with block -1 hold those.
    """
    first = np.concatenate([[0], np.cumsum(buckets)]).tolist()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = Block(batch.slice(k, 1).to_pylist()[0])
                for (keys, n), base, count in zip(asks(b), first, buckets, strict=False):
                    edges = np.array([i * ((1 << 64) // count) for i in range(count)], np.uint64)
                    cut = np.append(np.searchsorted(keys, edges), len(keys))
                    full = [i for i in range(count) if cut[i] < cut[i + 1]]
                    yield pa.record_batch({
                        "bucket": pa.array([base + i for i in full], pa.int64()), "block": pa.array([b.block] * len(full), pa.int64()),
                        "part": pa.array([b.part] * len(full), pa.int32()),
                        "keys": pa.array([put_sorted(keys[cut[i]:cut[i + 1]]) for i in full], pa.binary()),
                        "n": pa.array([put(n[cut[i]:cut[i + 1]].astype("<u4")) for i in full], pa.binary())})

    def reply(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys = [got_sorted(r["keys"]) for r in rows]
        cut = np.cumsum([0] + [len(k) for k in keys])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        parts = sorted({r["part"] for r in rows})
        sums = np.zeros((len(parts), len(distinct)), np.int64)
        for r, lo, hi in zip(rows, cut[:-1], cut[1:], strict=True):
            sums[parts.index(r["part"])][at[lo:hi]] += got(r["n"], "<u4")  # keys of one block are distinct
        said, stats = answer(sums, np.array(parts))
        k = len(rows)
        return pa.table({
            "block": pa.array([r["block"] for r in rows] + [-1], pa.int64()), "part": pa.array([r["part"] for r in rows] + [-1], pa.int32()),
            "bucket": pa.array([rows[0]["bucket"]] * (k + 1), pa.int64()),
            "counts": pa.array([put(said[..., at[lo:hi]]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)] + [None], pa.binary()),
            "stats": pa.array([None] * k + [stats], pa.list_(pa.int64()))})

    return folder.put(blocks.mapInArrow(ask, ASK).repartition(first[-1], "bucket").groupBy("bucket").applyInArrow(reply, ANSWER), name)


def answers_of(rows: pa.Table, low: int, high: int, dtype: str, width: int) -> np.ndarray:
    """A block's answers from the buckets of one kind, in the order of its keys; width numbers for each key."""
    mine = sorted((r for r in rows.select(["bucket", "counts"]).to_pylist() if low <= r["bucket"] < high), key=lambda r: r["bucket"])
    return np.concatenate([np.zeros((width, 0), dtype)] + [got(r["counts"], dtype).reshape(width, -1) for r in mine], axis=1)


def arrow_kind(df: DataFrame, column: str) -> pa.DataType:
    field = next((f for f in df.schema.fields if f.name == column), None)
    return to_arrow_type(field.dataType if field else LongType())
