"""Token counts through a cache keyed by content digest and tokenizer version.

Normalised content is reduced to a digest and looked up among stored counts of the same tokenizer version.
Each distinct content that misses is encoded once and appended to the store.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_keyed, materialise, shared_dir, text_of

#: Raise it when the normalisation below changes: stored counts of other versions are then not used.
NORMALISATION = 1
CACHE_SCHEMA = "digest string, n_tokens long, tokenizer_version string"
#: Words whose counts a worker remembers.
REMEMBERED = 200_000

# The ranges that Unicode gives letters, numbers and white space up to U+017F.
LETTERS, NUMBERS, WHITE = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
PLAIN = re.compile("[\x00-ſ]*")
#: The split of the tokenizer file word_bpe_49k.json, with its classes spelled out for such texts.
WORD_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{WHITE}{LETTERS}{NUMBERS}]+")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts the tokens of texts as the tokenizers library does with the given file.

    For a byte-level BPE whose words end in a suffix, with NFC, white-space and lower-case normalisation, words of
    texts up to U+017F are looked up one by one; other texts, special strings and other kinds of tokenizer go to
    the library whole.
    """

    def __init__(self, content: str):
        self.whole = tokenizers.Tokenizer.from_str(content)
        spec = json.loads(content)
        self.special = [t["content"] for t in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix")
        self.words: dict[str, int] | None = None
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if suffix and kinds == ["NFC", "Replace", "Lowercase"] and split == known:
            self.piece = self._pieces(spec["model"]["vocab"], suffix)
            self.words = {}

    def _pieces(self, vocab: dict[str, int], suffix: str) -> Callable[[str], int]:
        """Merges words by rank. The suffix is written as byte 255, which UTF-8 never has, and joins first."""
        letters = byte_letters()
        end = b"\xff"
        ranks = {bytes([b]): b for b in range(256)}
        for word, rank in vocab.items():
            if word in self.special:
                continue
            tail = word.endswith(suffix)
            raw = bytes(letters[c] for c in (word[: -len(suffix)] if tail else word)) + end * tail
            if len(raw) > 1:
                ranks[raw] = 1000 + rank if len(raw) > 2 or not tail else 256 + letters[word[0]]
        core = tiktoken.Encoding("words", pat_str=r"(?s:.)", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return lambda word: len(core.encode_single_piece(word.encode() + end))

    def __call__(self, text: str) -> int:
        if self.words is None or PLAIN.fullmatch(text) is None or any(s in text for s in self.special):
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        total, words = 0, self.words
        for word in WORD_SPLIT.findall(text.lower()):
            n = words.get(word)
            if n is None:
                if len(words) >= REMEMBERED:
                    words.clear()
                n = words[word] = self.piece(word)
            total += n
        return total


@lru_cache(maxsize=2)
def counter(content: str) -> Counter:
    """One for a worker, which runs many tasks."""
    return Counter(content)


def tokenizer_version(content: str) -> str:
    return hashlib.sha256(f"{NORMALISATION}:{tokenizers.__version__}:{content}".encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer_path`` is read on the driver and its content sent along; ``cache_path`` is a folder that Spark can
    read and write, a new one where None. Null and empty texts have no bytes and no tokens. Repeated rows
    and equal texts are encoded once and counted alike. No rows give no rows. Other columns are ignored. Runs of
    spaces, tabs and line ends count as one space, which no count depends on since the tokenizer drops white
    space; for a tokenizer that keeps it the content is taken as it is.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    version = tokenizer_version(content)
    drops_white = '"pattern": {"Regex": "\\\\s+"}' in json.dumps(json.loads(content).get("normalizer"))
    text = text_of("text")
    norm = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")) if drops_white else text
    missing = docs.select(norm.alias("content")).select(F.sha2("content", 256).alias("digest"), "content").distinct()
    bytes_of = F.octet_length(text).cast("long").alias("n_bytes")
    keyed = materialise(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", bytes_of, F.unhex(F.sha2(norm, 256)).alias("digest")))
    path = cache_path or shared_dir(spark)
    if _exists(spark, path):
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("tokenizer_version") == version)
        missing = missing.join(stored.select("digest"), "digest", "left_anti")
    sent = spark.sparkContext.broadcast(content)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(sent.value)
        for b in batches:
            n = [count(t) for t in b["content"]]
            yield pd.DataFrame({"digest": b["digest"], "n_tokens": n, "tokenizer_version": version})

    missing.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(path)
    # Two runs that share a cache may both append a content; a digest still has one row here.
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("tokenizer_version") == version)
    if cache_path:
        stored = stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    stored = stored.select(F.unhex("digest").alias("digest"), "n_tokens")
    found = attach_keyed(keyed, stored, "digest", "rid")  # a third of all rows may have one text
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
