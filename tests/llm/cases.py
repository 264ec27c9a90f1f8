"""Small tables with the awkward rows every operator must handle, and brute-force helpers."""

import re
import zlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside: they must not clash
EXTRA = ["n", "key", "score", "digest", "block", "part", "_id", "word", "th", "found", "rep", "component", "name", "pos", "line"]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(n=200, sf=SF):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()[:n]


def awkward(rows):
    """The rows, and null, empty, blank, long and repeated ones, a null id, and an id with two texts."""
    long = " ".join(f"w{i % 977} and thé 日本" for i in range(20_000))
    more = [(900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, long), (900_005, rows[0]["text"]), (900_005, rows[0]["text"]),
            (None, rows[1]["text"]), (None, None), (900_006, "one"), (900_006, "two words"), (900_007, "!!! ... \n...")]
    keep = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows]
    return keep + [(i, t, None, None, None) for i, t in more]


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


def empty(spark):
    return frame(spark, [])


def fold(doc_id, m):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def components(nodes, links):
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}
