"""Best-two-fit packing of token sequences.

Documents are cut into pieces of at most the sequence's length. Only how many pieces have each length matters
for packing, so the plan is made from that table, which has as many rows as a sequence has tokens, however large
the corpus. Bins are filled greedily; then a bin's smallest piece gives way to two unpacked ones
if these fit its gap more tightly. Each piece then takes the place that its rank among its length gives it.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, text_of
from .token_counts import byte_letters

CAPACITY = 2048
#: The split of byte-level vocabularies, a published pattern.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """Ids of a byte-level BPE file as the tokenizers library gives them, by the same ranks in a faster encoder."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.content, self.library = content, None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the fast split gives up on some extreme runs of white space; the library doesn't
            self.library = self.library or tokenizers.Tokenizer.from_str(self.content)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(content: str) -> ByteEncoder:
    """One for a worker, which runs many tasks."""
    return ByteEncoder(content)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; longer documents are cut, their first piece the short one."""
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(sent.value)
        end = np.array([end_id], np.uint32)
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.concatenate([encode(text), end]).astype("<u4", copy=False)
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for i, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    out.append((doc_id, i, x, y - x, zlib.crc32(ids[x:y].tobytes())))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64" if id_type in ("bigint", "int") else object)
            yield frame

    texts = docs.select("doc_id", text_of("text").alias("text"))
    return texts.mapInPandas(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Patterns (pieces of each length in a bin, number of such bins) for so many pieces of each length; bins in all.

    A pattern repeats while its pieces last, as filling one bin after another would. Each pattern uses up
    some length to less than what it needs, so patterns number a few thousand at most whatever the counts.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns, bins = [], 0
    while left.any():
        use: dict[int, int] = {}
        gap = capacity
        have = left.copy()

        def largest(most: int, have: np.ndarray = have) -> int:
            found = np.flatnonzero(have[: most + 1])
            return int(found[-1]) if len(found) else 0

        while gap and (x := largest(gap)):
            n = min(int(have[x]), gap // x)
            use[x] = use.get(x, 0) + n
            have[x] -= n
            gap -= n * x
        small = min(use)
        if gap and sum(use.values()) > 1:
            room = gap + small
            ones = np.flatnonzero(have[: room + 1])
            if len(ones):
                lengths = np.arange(capacity + 1)
                upto = np.maximum.accumulate(np.where(have > 0, lengths, 0))
                below = np.minimum(ones, room - ones)
                two = upto[below]
                same = (two == ones) & (have[ones] < 2)
                two = np.where(same, upto[np.maximum(ones - 1, 0)], two)
                total = np.where(two > 0, ones + two, 0)
                best = int(total.argmax())
                if total[best] > small:
                    use[small] -= 1
                    if not use[small]:
                        del use[small]
                    for x in (int(ones[best]), int(two[best])):
                        use[x] = use.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= n * times
        patterns.append((use, times))
        bins += times
    return patterns, bins


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces a sequence, offset of the first)."""
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for use, times in patterns:
        offset = 0
        for length in sorted(use, reverse=True):
            n = use[length]
            places.setdefault(length, []).append((given.get(length, 0), sequence, n, offset))
            given[length] = given.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in places.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document has at least its end id, so null and empty texts give a piece of one token. Repeated rows are packed
    like others; ties between pieces of a length go by id. No rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = materialise(cut_pieces(docs, tokenizer_path, capacity).withColumn("rid", F.monotonically_increasing_id()))
    n = pieces.count()
    buckets = 1 << max(4, min(12, math.ceil(math.log2(max(2, n)) / 2)))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int"))
    by_bucket = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan_bins(counts, capacity)[0]))
    upto = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = by_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "rid")) - 1
    ranks = pieces.withColumn("nth", nth).join(before, ["length", "bucket"])
    ranks = ranks.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            lengths, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            starts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
            for at in np.split(order, starts[1:]) if len(order) else []:
                length = int(lengths[at[0]])
                p = places.value[length]
                row = p[np.searchsorted(p[:, 0], rank[at], side="right") - 1]
                inner = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + inner // row[:, 2]
                offset[at] = row[:, 3] + inner % row[:, 2] * length
            yield b.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranks.mapInPandas(place, schema)
