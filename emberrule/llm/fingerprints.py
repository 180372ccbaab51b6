"""Bottom-k fingerprints of word shingles: mergeable, and estimating resemblance, containment and distinct counts."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Hashes kept of a text, and words in a shingle.
K, SHINGLE = 256, 5
WORDS = re.compile(r"\w+")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, the most recent few hundred thousand remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """A hash for each run of ``size`` words, in order; a text with fewer words is one run, one without words none."""
    words = WORDS.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for i in range(min(size, len(h))):
        out = mix64(out * _SPREAD + h[i : i + n])
    return out


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    if len(hashes) > 4 * k:  # far fewer than all need sorting, unless most repeat
        few = np.unique(np.partition(hashes, 2 * k)[: 2 * k + 1])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what ``a`` and ``b`` sketch."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard likeness of the two sets; exact if both have at most k members. Two empty sets are alike."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def distinct(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_shingles (estimated).

    The next document is that of the next id, ties by text, null ids last; after the last the first. A single document
    is its own next. Null texts are empty; empty texts have an empty fingerprint, and two of these are alike. No rows
    give no rows. Other columns are ignored.

    Rows move once: ranges of ids go to one task each, and each range also gets the first document of the next one.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / ranges for i in range(1, ranges)]
    ids = docs.select("doc_id")
    bounds = ids.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, steps)), 20 * ranges)).first()[0] or []
    edges = np.array(sorted(set(bounds)), np.int64)  # one a range

    @F.pandas_udf("int")
    def range_of(x: pd.Series) -> pd.Series:
        found = np.searchsorted(edges, x.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(x.isna(), len(edges), found).astype(np.int32))

    firsts = ids.withColumn("part", range_of("doc_id")).groupBy("part").agg(F.min("doc_id").alias("first")).orderBy("part").collect()
    goes = [(firsts[(i + 1) % len(firsts)]["first"], r["part"]) for i, r in enumerate(firsts)]
    goes = spark.createDataFrame(goes, f"first {kind}, part int") if goes else spark.createDataFrame([], f"first {kind}, part int")
    rows = docs.select("doc_id", text_of("text").alias("text"))
    own = rows.withColumn("part", range_of("doc_id")).withColumn("extra", F.lit(False))
    extra = rows.join(F.broadcast(goes), F.col("doc_id").eqNullSafe(F.col("first")))  # a row a range
    extra = extra.select("doc_id", "text", "part", F.lit(True).alias("extra"))
    dealt = own.unionByName(extra).repartition(max(1, ranges // 8), "part")
    dealt = dealt.sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_last(), "text")

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()

        def of(text: str) -> np.ndarray:
            return bottom(shingle_hashes(text, hashes, size), k)

        last: tuple | None = None  # (part, id, text, sketch) that waits for its next document
        for b in batches:
            out: list[tuple] = []
            for part, extra, doc_id, text in zip(b["part"], b["extra"], b["doc_id"], b["text"], strict=True):
                mine = of(text) if last or not extra else None
                if last and last[0] == part:
                    changed = edited(last[2], text)
                    other = of(changed)
                    sha = hashlib.sha256(changed.encode()).hexdigest()
                    near = resemblance(last[3], other, k), resemblance(last[3], mine, k)
                    out.append((last[1], len(last[2]), sha, encode(last[3]), encode(other), *near, distinct(last[3], k)))
                last = None if extra else (part, doc_id, text, mine)
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"
    return dealt.mapInPandas(sketch, schema)
