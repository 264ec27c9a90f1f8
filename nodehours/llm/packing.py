"""Packing of documents into fixed sequences along a space-filling curve."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodehours.llm.common import Folder, body
from nodehours.llm.tokens import encoder

DIMS = 3  # dimensions of the curve
BITS = 10  # bits of each coordinate
BUCKETS = 1024  # entries of a hashed document vector
RANGE_TOKENS = 4_000_000  # ids of a stretch of the curve in a small corpus; see ranges_for
CHUNK = 32  # ids between places where a document may be cut
SPREAD = 4.0  # coordinates are clipped to this many standard deviations


def hilbert_keys(coords: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of integer coordinates below 2**bits."""
    x = coords.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):  # undo the rotations, highest bit first
        q = 1 << b
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] >> b) & 1, flip ^ ((1 << b) - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def _hashed(ids: np.ndarray) -> np.ndarray:
    """Bucket of each id in the document vector."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(BUCKETS)


def _measured(tokenizer: str, ranks: str | None, end_id: int, seed: int):
    """Length, checksums of chunks and curve key of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, plane = encoder(tokenizer, ranks), _projection(seed)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, crcs, vectors = [], [], np.zeros((part.num_rows, BUCKETS), np.float32)
                for r, t in enumerate(part["text"]):
                    ids = np.append(encode(t.as_py()), np.uint32(end_id)).astype("<u4")
                    raw = memoryview(ids).cast("B")
                    n.append(len(ids))
                    crcs.append(np.array([zlib.crc32(raw[i:i + 4 * CHUNK]) for i in range(0, len(raw), 4 * CHUNK)], "<u4").tobytes())
                    vectors[r] = np.bincount(_hashed(ids).astype(np.int64), minlength=BUCKETS)
                vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
                at = np.clip((vectors @ plane + SPREAD) / (2 * SPREAD), 0, 1 - 1e-6)
                keys = hilbert_keys((at * (1 << BITS)).astype(np.int64), BITS)
                yield pa.record_batch({"doc_id": part["doc_id"], "doc_tokens": pa.array(n, pa.int64()),
                                       "crcs": pa.array(crcs, pa.binary()), "curve": pa.array(keys, pa.int64())})

    return run


_ZEROS = bytes(4 * CHUNK)


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two strings put together, from theirs; the second has at most one chunk's bytes.

    The checksum after a string is linear in the checksum before it, up to what zeros of that length give.
    """
    zeros = _ZEROS[:second_bytes]
    return second ^ zlib.crc32(zeros, first) ^ zlib.crc32(zeros)


def _packed(capacity: int):
    """Fill sequences with the documents of one stretch of the curve, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        sequence, fill = 0, 0
        for batch in batches:
            rows = []
            for doc, n, crcs in zip(batch["doc_id"].to_pylist(), batch["doc_tokens"].to_pylist(), batch["crcs"].to_pylist(), strict=True):
                sums, start = np.frombuffer(crcs, "<u4").tolist(), 0
                while start < n:
                    length = min(n - start, capacity - fill)
                    if start + length < n:
                        length -= length % CHUNK
                    if length == 0:
                        sequence, fill = sequence + 1, 0
                        continue
                    crc = 0
                    for i in range(start // CHUNK, -(-(start + length) // CHUNK)):
                        crc = joined_crc(crc, sums[i], 4 * min(CHUNK, start + length - i * CHUNK))
                    rows.append((doc, start, length, crc, n, base | sequence, fill))
                    start, fill = start + length, fill + length
                    if fill == capacity:
                        sequence, fill = sequence + 1, 0
            if rows:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                types = [batch["doc_id"].type] + [pa.int64()] * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    return run


def ranges_for(tokens: int) -> int:
    """Stretches of the curve for so many ids: the three-quarter power of their number in RANGE_TOKENS.

    A stretch leaves one sequence open, less than a thousandth of its ids. Stretches grow with the corpus, so that the
    lengths and checksums of one stay some tens of megabytes and tasks do not become too many: 30 for 0.5 GB, 130,000 for 100 TB.
    """
    return max(1, math.ceil((tokens / RANGE_TOKENS) ** 0.75))


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 2048, end_id: int = 1,
         seed: int = 7, ranges: int | None = None) -> DataFrame:
    """Sequences of at most capacity ids, filled with documents that lie close together on a Hilbert curve.

    A document's ids (with end_id after them) are hashed into a count vector of unit length, projected to a few
    dimensions and placed on the curve. Documents are range-sorted by place and id, and each range is packed by one
    task in order; their number follows the ids alone (ranges_for). A document that does not fit is cut after a multiple of CHUNK ids from its start, so a sequence is
    padded by less than CHUNK, but for the last of each range. Texts are encoded once; from there on only lengths, checksums
    of chunks and keys move, and a piece's checksum is joined from those of its chunks.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts are
    the end id alone. Copies share a place and are split by id; repeated rows are packed each. An empty
    table gives no rows. Other columns are ignored.
    """
    folder = Folder(docs.sparkSession, "pack")
    kind = dict(docs.dtypes)["doc_id"]
    measured = folder.put(
        docs.select("doc_id", body().alias("text"))
        .mapInArrow(_measured(tokenizer, ranks, end_id, seed), f"doc_id {kind}, doc_tokens long, crcs binary, curve long"), "measured")
    ranges = ranges or ranges_for(measured.agg(F.sum("doc_tokens")).first()[0] or 0)
    placed = measured.repartitionByRange(ranges, "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "doc_tokens", "crcs")
    return placed.mapInArrow(_packed(capacity), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                             "sequence_id long, offset long")
