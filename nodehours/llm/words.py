"""Words of whole Arrow columns of texts, numbered within a batch."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WHITE = " \t\n\x0b\x0c\r"
MIX = np.uint64(0x9E3779B97F4A7C15)


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Runs of characters other than ASCII white space, A-Z lowered if asked.

    Returns offsets (words of text i are offsets[i] to offsets[i + 1]), the number of each word in the vocabulary,
    and the vocabulary. Null texts have no words.
    """
    texts = pc.fill_null(texts, "")
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = pieces.flatten()
    at = np.asarray(pieces.offsets).astype(np.int64)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():  # white space at either end leaves empty pieces
        flat = flat.filter(pa.array(full))
        at = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])[at - at[0]]
    coded = pc.dictionary_encode(flat)
    return at - at[0], np.asarray(coded.indices).astype(np.int32), coded.dictionary.to_pylist()


def stripped(offsets: np.ndarray, codes: np.ndarray, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The same words without ASCII punctuation at their ends; words of nothing else stay."""
    coded = pc.dictionary_encode(pa.array([w.strip(string.punctuation) or w for w in vocabulary], pa.string()))
    return offsets, np.asarray(coded.indices)[codes], coded.dictionary.to_pylist()


def hashes(vocabulary: list[str]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes of text (one longer text makes a batch of its own)."""
    for b in batches:
        size = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b[column]), 0)).astype(np.int64))])
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + most_bytes, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values over each stretch between offsets; empty stretches give 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
