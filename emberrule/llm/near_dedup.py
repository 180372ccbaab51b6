"""Near-duplicates by Order MinHash and banded alignment.

A text is the sequence of its runs of five words, each labelled with how often it has occurred before. A sketch takes
the few of least hash and keeps them in text order, so it agrees for texts that share the runs in the same order.
Texts whose sketches agree in a band are candidates; an alignment within a band of diagonals decides.

Groups may be huge. In each turn a text is compared with a few leaders of its buckets, links are contracted, and buckets
whose texts are all of one group are done. What is left, pairs of different groups that share a bucket, is
compared in full in small buckets; in large ones a filter that loses none finds those that can be alike.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_group, free_plans, materialise, text_of
from .fingerprints import SHINGLE, WordHashes, mix64, shingle_hashes

#: Least similarity: runs aligned of the runs in either text.
SIMILARITY = 0.8
#: Sketches of a text, and runs in each: of long pairs at 0.8, one in 37,000 agrees in no sketch, of 12 runs in 15 one in 8,000.
SKETCHES, MINIMA = 20, 4
#: Runs below which a text is compared with all that share a run with it; a text alike has at most SHORT_PEER.
SHORT = 10
SHORT_PEER = int((SHORT - 1) / SIMILARITY + 1e-9)
#: Turns in which each text is compared with leaders: those of its buckets, then those of the parts that agree in one and in two more sketches.
TURNS = ((0,), (1, 2))
#: Leaders of a text and turn, those that it shares most buckets with.
LEADERS = 3
#: Members of a bucket up to which all their pairs of different groups are compared; larger ones go to the search by runs.
FEW = 16
#: Rows of a run that one piece of the search for pairs across groups takes, about.
SHARE = 256
#: Pairs of a text that one copy of its runs serves, about.
PIECE = 64

_SEEDS = mix64(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD, _FLIP = _SEEDS[:SKETCHES] | np.uint64(1), _SEEDS[SKETCHES:]


def labelled_runs(text: str, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """A hash for each run of words and its occurrence number, in order; no two are alike."""
    runs = shingle_hashes(text, hashes, size)
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(runs) else np.zeros(0, bool)
    if new.all():
        return mix64(runs)
    at = np.arange(len(runs))
    nth = np.empty(len(runs), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return mix64(runs + mix64(nth) * (nth > 0))


def sketch(runs: np.ndarray) -> np.ndarray:
    """The bands' keys of a non-empty sequence of labelled runs."""
    n = len(runs)
    take = min(MINIMA, n)
    keys = np.empty(SKETCHES, np.uint64)
    step = max(1, 2_000_000 // n)  # so many sketches at once, for bounded memory
    for at in range(0, SKETCHES, step):
        rows = slice(at, min(at + step, SKETCHES))
        x = (runs[None, :] ^ _FLIP[rows, None]) * _ODD[rows, None]
        where = np.argpartition(x, take - 1, axis=1)[:, :take] if n > take else np.broadcast_to(np.arange(n), (len(x), n))
        chosen = runs[np.sort(where, axis=1)]
        key = np.arange(rows.start, rows.stop, dtype=np.uint64)
        for i in range(take):
            key = mix64(key * np.uint64(0xD1342543DE82EF95) + chosen[:, i])
        keys[rows] = key
    return keys


def bucket_keys(runs: np.ndarray) -> np.ndarray:
    """The sketches of a sequence of labelled runs, and of a short one its runs too: sketches miss too many of these."""
    if not len(runs):
        return np.zeros(0, np.uint64)
    return np.concatenate([sketch(runs), mix64(runs)]) if len(runs) <= SHORT_PEER else sketch(runs)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Runs aligned in order, of the runs in either; 0.0 where it can't reach ``least``.

    Labels are unique, so the alignment is the longest increasing run of b's positions in a's order. Texts alike enough
    differ in at most (1 - least) of their union, which bounds how far apart aligned positions lie: the band.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    need = least / (1 + least) * (len(a) + len(b)) - 1e-9  # aligned / (a + b - aligned) >= least
    if min(len(a), len(b)) < need:
        return 0.0
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(at, kind="stable")
    at, to = at[order], to[order]
    band = int(np.ceil(len(a) + len(b) - 2 * need))
    to = to[np.abs(at - to) <= band]
    if len(to) < need:
        return 0.0
    if (to[1:] > to[:-1]).all():
        n = len(to)
    else:
        ends: list[int] = []
        for x in to.tolist():
            i = bisect_left(ends, x)
            ends[i : i + 1] = [x]
        n = len(ends)
    return n / (len(a) + len(b) - n) if n >= need else 0.0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b; numbers) but the roots, by alternating star contraction.

    Each round writes its edges to shared storage. A node may have any number of neighbours: minima are
    taken by salted parts.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def open_() -> bool:  # a node has two roots, or a root has one
        parts = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        sums = parts.groupBy("x").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n"))
        return not sums.filter((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("ups") < F.col("n")))).isEmpty()

    while open_():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = attach_group(both, ["u"], "v", [F.min("v").alias("m")], [F.min("m").alias("m")]).withColumn("m", F.least("u", "m"))
        large = least.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = attach_group(large, ["u"], "v", [F.min("v").alias("m")], [F.min("m").alias("m")])
        small = least.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = materialise(small.filter("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _sketches(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            cls, n, keys = [], [], []
            for text in b["text"]:
                runs = labelled_runs(text, hashes)
                cls.append(hashlib.blake2b(runs.tobytes(), digest_size=16).digest())
                n.append(len(runs))
                keys.append(bucket_keys(runs).view(np.int64))
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_key": b["text_key"], "cls": cls, "n": n, "keys": keys})

    rows = docs.select("doc_id", F.xxhash64(text_of("text")).alias("text_key"), text_of("text").alias("text"))
    schema = f"doc_id {kind}, text_key long, cls binary, n long, keys array<long>"
    return rows.mapInPandas(make, schema).withColumn("rid", F.monotonically_increasing_id())


def _runs_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and the bytes of its labelled runs for each row of ``wanted`` (rep, doc_id, text_key)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            yield pd.DataFrame({"rep": b["rep"], "runs": [labelled_runs(t, hashes).tobytes() for t in b["text"]]})

    w = wanted.select("rep", F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    rows = docs.select("doc_id", F.xxhash64(text_of("text")).alias("text_key"), text_of("text").alias("text"))
    found = rows.join(w, rows["doc_id"].eqNullSafe(w["__id"]) & (rows["text_key"] == w["__key"])).select("rep", "text")
    return found.mapInPandas(make, "rep long, runs binary").dropDuplicates(["rep"])


def _dealt(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """``pairs`` with ``part_<key>``: the pairs of one text dealt into pieces of about PIECE."""
    sized = attach_group(pairs, [key], other, [F.count(F.lit(1)).alias("__c")], [F.sum("__c").alias("__n")])
    piece = F.pmod(F.xxhash64(F.lit(5), other), F.ceil(F.col("__n") / PIECE)).cast("int")
    return sized.withColumn(f"part_{key}", piece).drop("__n")


def _verified(pairs: DataFrame, runs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are alike. A text may be in any number of pairs: each piece of them gets one copy of its runs."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = [aligned(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) >= least for x, y in zip(p["x"], p["y"], strict=True)]
            yield p.loc[ok, ["a", "b"]]

    dealt = materialise(_dealt(_dealt(pairs.select("a", "b"), "a", "b"), "b", "a"))
    both = dealt
    for key, out in (("b", "y"), ("a", "x")):
        at = [key, f"part_{key}"]
        copies = dealt.select(*at).distinct().join(runs.select(F.col("rep").alias(key), F.col("runs").alias(out)), key)
        both = both.join(copies, at)
    return both.select("a", "b", "x", "y").mapInPandas(check, "a long, b long")


def _open(members: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """Members (bucket, rep, n, score) of buckets that hold texts of several groups, with their root, the bucket's size and a leader.

    The first turn's leader is the member that shares buckets with most others, near the middle of its group; later ones are drawn, a
    text being first or last in all its buckets.
    """
    if roots is None:
        now = members.withColumn("root", F.col("rep"))
    else:
        now = members.join(roots, members["rep"] == roots["node"], "left").withColumn("root", F.coalesce("root", "rep")).drop("node")
    key = -F.col("score") if turn == 0 else F.xxhash64(F.lit(turn), "rep")
    head = F.struct(key.alias("key"), "rep", "n", "root")
    partial = [F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(head).alias("h")]
    final = [F.sum("c").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("h").alias("leader")]
    return attach_group(now, ["bucket"], "rep", partial, final).filter("lo <> hi").drop("lo", "hi")


def _deeper(members: DataFrame, keys: DataFrame, more: int) -> DataFrame:
    """Members (with ``band``) by buckets of those that agree in ``more`` of the next sketches as well."""
    if not more:
        return members
    after = [F.get("keys", F.pmod(F.col("band") + i, F.lit(SKETCHES)).cast("int")) for i in range(1, more + 1)]
    deep = F.when(F.col("band") < SKETCHES, F.xxhash64("bucket", *after)).otherwise(F.col("bucket"))
    return members.join(keys, "rep").withColumn("bucket", deep).drop("keys")


def _stars(opened: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b): each text with the leaders of other groups that it shares most buckets with."""
    may = opened.filter((F.col("root") != F.col("leader.root")) & (F.least("n", "leader.n") >= F.greatest("n", "leader.n") * least))
    shared = may.groupBy("rep", F.col("leader.rep").alias("a")).agg(F.count(F.lit(1)).alias("c"), F.min("leader.key").alias("key"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "key", "a"))), 1, LEADERS)  # of as many as a text has buckets
    pairs = shared.groupBy("rep").agg(best.alias("l")).select(F.col("rep").alias("b"), F.explode("l.a").alias("a"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """The roots after the links (a, b) of ``found``."""
    old = [] if roots is None else [roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]
    return components(reduce(DataFrame.unionByName, old, found))


def _across(reps: DataFrame, runs: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of ``reps`` (rep, n, root) with different roots that can be alike, and some that aren't.

    Texts alike share a run among the first of either, in one order of all runs, if so many are taken that the others
    are too few. The order is by rareness, so that runs which a large group shares come last. Of two groups that share a run at
    least one isn't the largest that has it: only rows of the others look for partners.
    """
    reps = attach_group(reps, ["root"], "rep", [F.count(F.lit(1)).alias("c")], [F.sum("c").alias("mass")])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(len(b)):
                row = b.iloc[at]
                yield pd.DataFrame({"run": np.frombuffer(row["runs"], np.int64)}).assign(rep=row["rep"], n=row["n"], root=row["root"], mass=row["mass"])

    rows = materialise(reps.join(runs, "rep").select("rep", "n", "root", "mass", "runs").mapInPandas(each, "run long, rep long, n long, root long, mass long"))
    partial = [F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("mass", "root")).alias("top")]
    rows = attach_group(rows, ["run"], "rep", partial, [F.sum("c").alias("df"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("top").alias("top")])
    runs_of = F.array_sort(F.collect_list(F.struct("df", "run", (F.col("lo") != F.col("hi")).alias("mixed"), F.col("top.root").alias("top"))))
    lists = rows.filter("df > 1").groupBy("rep", "n", "root").agg(runs_of.alias("l"))  # the others come first and have no partners
    first = lists.select("rep", "n", "root", F.posexplode("l").alias("i", "r"), (F.col("n") - F.size("l")).alias("alone"))
    first = first.select("rep", "n", "root", "r.*", (F.col("alone") + F.col("i")).alias("at"))
    first = first.filter(F.col("mixed") & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9)))
    first = materialise(first.withColumn("parts", F.ceil(F.col("df") / SHARE).cast("int")).drop("df", "mixed"))
    x = first.filter("root <> top").select("run", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"{c}_x") for c in ("rep", "n", "root", "at")))
    y = first.select("run", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "rep", "n", "root", "at")
    need = (F.col("n") + F.col("n_x")) * (least / (1 + least)) - 1e-9
    pairs = x.join(y, ["run", "part"]).filter((F.col("root") != F.col("root_x")) & (F.least(F.col("n") - F.col("at"), F.col("n_x") - F.col("at_x")) >= need))
    return pairs.select(F.least("rep", "rep_x").alias("a"), F.greatest("rep", "rep_x").alias("b")).distinct()


def near_dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, group_id, group_size, kept, text_key.

    Texts with equal words are one class from the start. Groups are the connected components of verified links; of
    each the row of least id stays (null ids last, then any one of rows with the same id), whose id is ``group_id``. Texts without words, null
    ones too, are one group; a text with less than five words is alike only to the same words. No rows give no rows. Other
    columns are ignored. ``text_key`` is a hash of the text as given.
    """
    made = materialise(_sketches(docs))
    rows = attach_group(made.select("rid", "doc_id", "text_key", "cls"), ["cls"], "rid", [F.min("rid").alias("r")], [F.min("r").alias("rep")])
    rows = materialise(rows.drop("cls"))
    firsts = made.join(rows.filter("rid = rep").select("rid"), "rid", "left_semi").filter("n > 0")
    members = firsts.select(F.col("rid").alias("rep"), "n", F.posexplode("keys").alias("band", "bucket"))
    counted = attach_group(members, ["bucket"], "rep", [F.count(F.lit(1)).alias("c")], [F.sum("c").alias("size")]).filter("size > 1")
    counted = materialise(counted)
    scores = counted.groupBy("rep").agg(F.sum("size").alias("score"))
    involved = rows.join(scores.select("rep"), "rep", "left_semi").filter("rid = rep").select("rep", "doc_id", "text_key")
    runs = materialise(_runs_of(docs, involved))
    near = lambda x, y: F.least(x, y) >= F.greatest(x, y) * least
    left, roots = counted.drop("size").join(scores, "rep"), None
    keys = materialise(firsts.select(F.col("rid").alias("rep"), "keys").join(scores.select("rep"), "rep", "left_semi"))
    for turn in TURNS:
        stars = reduce(DataFrame.unionByName, [_stars(_open(_deeper(left, keys, more), roots, more), least) for more in turn])
        roots = _joined(roots, materialise(_verified(materialise(stars.distinct()), runs, least)))
        free_plans(docs.sparkSession)
    left = materialise(_open(left, roots, len(TURNS)))
    few = left.filter(F.col("size") <= FEW)
    # All pairs of a few: at most FEW - 1 partners for each row.
    lists = few.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("rep", "n", "root"))).alias("l"))
    one = lists.select("l", F.posexplode("l").alias("i", "a"))
    two = one.select("a", F.explode(F.expr("filter(slice(l, i + 2, size(l)), x -> x.root <> a.root)")).alias("b"))
    pairs = two.filter(near(F.col("a.n"), F.col("b.n"))).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()
    found = _verified(materialise(pairs), runs, least)
    reps = left.filter(F.col("size") > FEW).select("rep", "n", "root").distinct()
    if not reps.isEmpty():
        found = found.unionByName(_verified(materialise(_across(reps, runs, least)), runs, least))
    roots = _joined(roots, materialise(found))
    free_plans(docs.sparkSession)
    grouped = rows.join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    grouped = attach_group(
        materialise(grouped.select("rid", "doc_id", "text_key", "root")),
        ["root"],
        "rid",
        [F.count(F.lit(1)).alias("n"), F.min(best).alias("best")],
        [F.sum("n").cast("long").alias("group_size"), F.min("best").alias("keep")],
    )
    kept = F.col("rid") == F.col("keep.rid")
    return grouped.select("doc_id", F.col("keep.doc_id").alias("group_id"), "group_size", kept.alias("kept"), "text_key")
