"""Token ids as a public tokenizer gives them, and token counts through a digest cache."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodehours.llm.common import BROADCAST_DIGESTS, Folder, body

# Printable ASCII, tab, line ends, and Latin letters and signs below U+0250: there the two libraries split texts alike.
_OTHER = re.compile("[^\t\n\r -~¡-ɏ]")
_LONGEST = 1_000_000  # characters up to which the faster library is used


@lru_cache(maxsize=4)
def encoder(tokenizer: str, ranks: str | None = None) -> Callable[[str], np.ndarray]:
    """A function from text to ids, built once per Python worker.

    The ids are those of the tokenizers library for the .json file (sentencepiece for .model), without
    added special tokens; special strings inside texts are handled as its default. With ranks, the same
    byte-level vocabulary in rank form, texts of characters on which both libraries agree go through
    tiktoken, which is about five times as fast; all others go through tokenizers itself.
    """
    if tokenizer.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda text: np.asarray(model.encode(text, add_bos=False, add_eos=False), np.uint32)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    whole.no_truncation()
    whole.no_padding()
    exact = lambda text: np.asarray(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    if ranks is None:
        return exact
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    specials = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if len(text) > _LONGEST or any(s in text for s in specials) or _OTHER.search(text):
            return exact(text)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def version(tokenizer: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    lib = f"sentencepiece {sentencepiece.__version__}" if tokenizer.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(tokenizer, "rb") as f:
        return hashlib.sha256(lib.encode() + f.read()).hexdigest()


def count_tokens(docs: DataFrame, tokenizer: str, ranks: str | None = None, cache: str | None = None,
                 limit: int = 1024, normalise: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """Tokens of every whole text, encoding only contents whose count is not yet stored.

    A content is known by the sha256 of its normalised text (no change by default) together with the digest of
    the tokenizer. Digests are joined to the stored counts; of the contents that miss, one row each is encoded, and
    the new counts are appended to the cache (a Parquet folder all executors share; by default one of this run).
    Copies move as digests, never as texts.

    Returns one row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). Null text is
    empty and has no tokens. Repeated rows and null ids come back as they are. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = Folder(spark, "counts")
    cache = cache or f"{folder.path}/cache"
    kind = version(tokenizer)
    text = docs.select("doc_id", normalise(body()).alias("text"), F.octet_length(body()).cast("long").alias("n_bytes"))
    text = text.withColumn("digest", F.sha2("text", 256))
    rows = folder.put(text.select("doc_id", "n_bytes", "digest"), "rows")

    def stored() -> DataFrame:
        known = spark.createDataFrame([], "digest string, n_tokens long, version string")
        jvm = spark._jvm.org.apache.hadoop.fs.Path(cache)
        if jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
            known = spark.read.schema(known.schema).parquet(cache)
        return known.where(F.col("version") == kind).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    # one row for each content that misses: the smallest id (a null id only where there is no other)
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    wanted = folder.put(first.join(stored(), "digest", "left_anti"), "wanted")
    mine = F.expr("digest = _digest AND doc_id <=> first_id")
    side = wanted.select(F.col("digest").alias("_digest"), "first_id")
    n_rows, n_wanted = rows.count(), wanted.count()
    if n_wanted and 2 * n_wanted > n_rows and n_rows - n_wanted <= BROADCAST_DIGESTS:  # few rows need no encoding: name those
        others = rows.join(side, mine, "left_anti").select(F.col("digest").alias("_digest"), F.col("doc_id").alias("first_id"))
        todo = text.join(F.broadcast(others), mine, "left_anti")
    else:
        todo = text.join(F.broadcast(side) if n_wanted <= BROADCAST_DIGESTS else side, mine, "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer, ranks)
        for b in batches:
            yield pa.record_batch({"digest": b["digest"], "n_tokens": pa.array([len(ids(t.as_py())) for t in b["text"]], pa.int64())})

    fresh = todo.select("digest", "text").mapInArrow(encode, "digest string, n_tokens long")
    if n_wanted:
        (fresh.dropDuplicates(["digest"]).withColumn("version", F.lit(kind))
         .write.mode("append").partitionBy("version").parquet(cache))
    counts = folder.put(stored().join(first.select("digest"), "digest", "left_semi"), "counts")  # a table, so that a skewed join can be split
    out = rows.join(counts, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
