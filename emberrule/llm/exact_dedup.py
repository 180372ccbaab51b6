"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text without its white space is cut where its own characters say so. A document's recipe is the ordered
list of its chunks' identifiers. Identifiers are verified: each distinct chunk travels once, and where two
different chunks share a digest they get different ordinals. Documents are then compared by their recipes,
lists of a few bytes a chunk, so long texts aren't moved again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import attach_group, materialise, text_of

#: What equality ignores.
WHITE = r"[\x20\x09-\x0D]+"
#: A chunk ends with such letters once it has MIN code points, or at MAX.
MIN_CHUNK, MAX_CHUNK = 256, 2048
CHUNK = rf"(?s).{{{MIN_CHUNK - 3},{MAX_CHUNK - 3}}}?[bdgkpvwz][aeiou][nrst]|.{{1,{MAX_CHUNK}}}"


def digest64(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(text, WHITE, ""), F.lit(CHUNK), F.lit(0))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = digest64
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, source_sha256.

    Texts are equal when identical without white space; null counts as empty, and all empty texts are equal.
    Of a group the row with the most code points stays, then the smallest id (null ids last), then any one of
    rows that agree in both. No rows give no rows. Other columns are ignored. ``source_sha256`` is that of the
    text as given, by which, with the id, a row of ``docs`` can be found again.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    cut = text.select(
        "doc_id",
        F.length("text").cast("long").alias("n_points"),
        F.sha2("text", 256).alias("source_sha256"),
        F.regexp_replace("text", WHITE, "").alias("norm"),
    ).select(
        "doc_id",
        "n_points",
        "source_sha256",
        F.sha2("norm", 256).alias("text_sha256"),
        F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks"),
    )
    recipes = materialise(
        cut.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            "n_points",
            "source_sha256",
            "text_sha256",
            F.transform("chunks", digest).alias("recipe"),
        )
    )
    # The chunk store: distinct chunks, first within each task. Equality of contents is what distinct compares.
    content = text.select(F.explode(chunks_of(F.col("text"))).alias("chunk"))
    store = content.select(digest(F.col("chunk")).alias("digest"), "chunk").distinct()
    shared = materialise(store.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"))
    if shared.isEmpty():
        recipes = recipes.withColumn("ordinals", F.array().cast("array<long>"))
    else:
        recipes = _with_ordinals(text, recipes, shared, digest)
    best = F.struct((-F.col("n_points")).alias("neg"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    grouped = attach_group(
        recipes,
        ["recipe", "ordinals"],
        "rid",
        [F.count(F.lit(1)).alias("n"), F.min(best).alias("best")],
        [F.sum("n").cast("long").alias("group_size"), F.min("best").alias("keep")],
    )
    return grouped.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        "text_sha256",
        "source_sha256",
    )


def _with_ordinals(
    text: DataFrame, recipes: DataFrame, shared: DataFrame, digest: Callable[[Column], Column]
) -> DataFrame:
    """The rest: chunks whose digest stands for several contents are told apart by their place among them."""
    pieces = text.select(
        "doc_id", F.sha2("text", 256).alias("source_sha256"), F.posexplode(chunks_of(F.col("text"))).alias("pos", "chunk")
    ).withColumn("digest", digest(F.col("chunk")))
    pieces = pieces.join(shared, "digest", "left_semi")
    order = Window.partitionBy("digest").orderBy("chunk")
    known = pieces.select("digest", "chunk").distinct().withColumn("ordinal", F.row_number().over(order).cast("long"))
    told = pieces.distinct().join(known, ["digest", "chunk"])
    by_doc = told.groupBy("doc_id", "source_sha256").agg(
        F.array_sort(F.collect_set(F.struct(F.col("pos").cast("long").alias("pos"), "ordinal"))).alias("o")
    )
    by_doc = by_doc.select(
        F.col("doc_id").alias("__id"),
        F.col("source_sha256").alias("__sha"),
        F.flatten(F.transform("o", lambda x: F.array(x["pos"], x["ordinal"]))).alias("ordinals"),
    )
    on = recipes["doc_id"].eqNullSafe(by_doc["__id"]) & (recipes["source_sha256"] == by_doc["__sha"])
    joined = recipes.join(by_doc, on, "left").drop("__id", "__sha")
    return materialise(joined.withColumn("ordinals", F.coalesce("ordinals", F.array().cast("array<long>"))))
