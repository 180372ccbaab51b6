"""A corpus pipeline over ``documents``: drop toxic texts, exact and near copies, mix the sources, pack sequences.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. Its rows are written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents, extra ones and those with names that operators use
too; the last returns the packed pieces. Repeated rows and ids, and null ids, are rows like others; a null text counts as
empty. No rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberrule.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from emberrule.llm.common import give_back, materialise, release, table, written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labels of ``sf_dir``, doesn't find toxic.

    Equal texts fare alike; texts without words, null ones too, all score the same. Without labels of both kinds nothing is found
    toxic unless toxic labels are the majority.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return docs.filter(toxicity.score_of(spark, model, F.col("text")) < toxicity.THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for white space: the longest, then that of least id, then any one."""
    verdicts = materialise(exact_dedup.exact_dedup(docs))
    return give_back(docs, verdicts, "kept", "source_sha256").select("__row.*")


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of least id, null ids last. Texts without words are one group."""
    verdicts = materialise(near_dedup.near_dedup(docs))
    return give_back(docs, verdicts, "kept", "text_key").select("__row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times. A null source is one more source."""
    verdicts = materialise(mixing.mix_sources(docs))
    counted = give_back(docs, verdicts, "copies", "source_sha256", ("doc_id", "source"))
    return counted.select("__row", F.explode(F.sequence(F.lit(1), F.col("__value").cast("int")))).select("__row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. An empty text is one piece of one id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", clean),
    ("exact dedup", distinct),
    ("minhash near dedup", unlike),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]
#: A trained classifier and a tokenizer can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way, and its input, go when its result is written."""
    docs = table(spark, sf_dir, "documents")
    began = written()
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        release(began, but_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
