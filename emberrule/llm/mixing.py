"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Each source's target says how often its words are expected in the mix. The whole part is taken as certain
copies of every document. For the rest, documents have unequal inclusion probabilities: in proportion to the square root of
their words, so that a target takes fewer documents than an equal draw would, and those for which that exceeds one are
certain. They are ranked by their random odds divided by their inclusion odds, and the sample is the front of
that order whose words make up the rest of the target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import attach_small, materialise, ranked, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: Copies of a document, and of a source, at most.
MOST = 3
#: Sources weigh so much in turn.
WEIGHTS = (1, 2, 3)


def _targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, int]:
    """source, source_size, target; and the number of sources."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = ranked(sources, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    sources = materialise(place.select("source", "source_size", weight.cast("long").alias("weight")))
    n, total, weight_sum = sources.agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("weight")).first()
    level = (total / weight_sum) if n and total else 0.0
    cap = F.col("source_size") * most
    while n and total:  # each round fixes at least one more source at its cap; the driver sees two sums
        above = F.col("weight") * F.lit(level) > cap
        capped, free = sources.agg(F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if not free or (total - capped) / free == level:
            break
        level = (total - capped) / free
    target = F.least(F.col("weight") * F.lit(float(level)), cap.cast("double"))
    return sources.select("source", "source_size", target.alias("target")), n


def _levels(rows: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """source and level: what the square root of a document's words is multiplied with for its inclusion probability.

    Expected words make up the rest of the target, the largest documents being certain where the product passes one.
    One row for each source and size goes into it.
    """
    sizes = rows.filter("size > 0").groupBy("source", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("words"))
    sizes = attach_small(sizes, targets.select("source", "rest"), "source", "size", n).filter("rest > 0")
    root = F.sqrt(F.col("size").cast("double"))
    order = Window.partitionBy("source").orderBy(F.col("size").desc())
    larger = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum(F.col("words") * root).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = sizes.withColumn("level", (F.col("rest") - larger) / others).filter(F.col("level") * root < 1)
    return found.groupBy("source").agg(F.max_by("level", "size").alias("level"))


def mix_sources(
    docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, sizes: DataFrame | None = None
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, copies, taken, source_sha256.

    ``size`` is the number of words (null text: 0). Targets share the corpus's words by weight, each at most
    ``most`` times its source's size, the excess reshared. A document is taken ``copies`` times, 0 to ``most``; one
    without words only in whole copies. A source's words differ from its target by no more than the best single document
    could mend: after the front of the order, one more document fills the gap if that brings the source nearer its
    target. Sources without words have target 0 and take nothing; a null source is a source of its own, the last. Ties
    in the order go by id, null ids first, then by any row. No rows give no rows. Other columns are ignored. Reruns agree.
    """
    unit = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(2.0**52)
    rows = sizes or materialise(
        docs.select("doc_id", "source", text_of("text").alias("text")).select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            "source",
            F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"),
            F.sha2("text", 256).alias("source_sha256"),
            unit.alias("unit"),
        )
    )
    targets, n = _targets(rows, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole)
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    levels = materialise(_levels(rows, targets, n).withColumnRenamed("source", "s"))
    targets = materialise(targets.join(levels, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    buckets = 1 << max(4, math.ceil(math.log2(max(2, rows.count())) / 2))  # as many buckets as rows in each
    chance = F.col("level") * F.sqrt(F.col("size").cast("double"))
    # Random odds over inclusion odds; certain documents come first. Sources without a rest have no order, nor has what has no words.
    rank = F.when(chance >= 1, 0.0).when(F.col("size") > 0, (F.col("unit") / (1 - F.col("unit"))) / (chance / (1 - chance)))
    rows = attach_small(rows, targets.select("source", "level"), "source", "rid", n).withColumn("rank", rank).drop("level")
    place = F.floor((1 - 1 / (1 + F.col("rank"))) * buckets)  # never falls where the rank rises
    rows = materialise(rows.withColumn("bucket", F.coalesce(place, F.lit(buckets)).cast("long")))
    # Where in the order the front ends: sums by bucket, then the order itself within one bucket a source.
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    ends = attach_small(sums, targets.select("source", "rest"), "source", "bucket", n).filter("upto > rest")
    ends = ends.groupBy("source").agg(F.min("bucket").alias("end"), F.min_by(F.col("upto") - F.col("words"), "bucket").alias("before"))
    info = materialise(
        targets.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    )
    known = attach_small(rows, info, "source", "rid", n)
    last = known.filter("bucket = `end` and rest > 0")
    so_far = Window.partitionBy("source").orderBy("rank", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = last.withColumn("words", F.col("before") + F.sum("size").over(so_far)).filter("words <= rest")
    cut = cut.groupBy("source").agg(F.max("words").alias("words"), F.max(F.struct("rank", "doc_id", "rid")).alias("cut"))
    info = info.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    info = materialise(info.withColumn("gap", F.col("rest") - F.coalesce("words", "before", F.lit(0))))
    known = attach_small(rows, info, "source", "rid", n)
    front = (F.col("rest") > 0) & (
        F.col("end").isNull()
        | (F.col("bucket") < F.col("end"))
        | ((F.col("bucket") == F.col("end")) & (F.struct("rank", "doc_id", "rid") <= F.col("cut")))
    )
    known = known.withColumn("front", F.coalesce(front, F.lit(False)))
    off = F.abs(F.col("gap") - F.col("size"))
    spare = known.filter(~F.col("front") & (F.col("rest") > 0) & (F.col("size") > 0) & (off < F.col("gap")))
    fill = spare.groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "doc_id", "rid")).alias("fill"))
    known = attach_small(known, materialise(fill.select("source", F.col("fill.rid").alias("fill"))), "source", "rid", n)
    more = (F.col("front") | F.coalesce(F.col("rid") == F.col("fill"), F.lit(False))).cast("long")
    return known.withColumn("copies", F.col("whole") + more).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source_sha256"
    )
