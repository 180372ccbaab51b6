"""Sanitisation of personal data by information theory (DataFrame functions only).

Patterns find the protected entities: e-mail addresses, IP addresses, card and phone numbers. How strongly a term
in a document with an entity reveals it is estimated from the whole corpus: the pointwise mutual information of the two, as a
share of the entity's own information, from smoothed counts of documents. A term that gives away most of it is removed, one
that gives away much is generalised, wherever it stands in the documents that hold the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_group, materialise, text_of

# The patterns. They match what their plain forms match; where giving characters back can't help they don't
# give any back, so that no text takes more than a few looks at each character.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Kinds in the order of the results; a text without the mark has no match.
KINDS = (("email", EMAIL, "@"), ("ip", IP, "."), ("card", CARD, None), ("phone", PHONE, "+"))
ADDED = ("generalise", "remove")
#: The shares of an entity's information from which a term is generalised or removed.
GENERALISE, REMOVE = 0.75, 0.9
#: Documents in which a term is taken to stand besides those counted, where the entity is as frequent as anywhere.
PRIOR = 2.0
#: Words, numbers and identifiers, of two characters at least.
TERM = r"[\p{L}\p{N}]{2,}"
_BLOCK = 64
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(19))), F.lit(0), add)
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def find_entities(docs: DataFrame) -> DataFrame:
    """rid, doc_id and found: an array of (kind, start, end, value) for each row; its text where there are any."""
    df = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_of("text").alias("text"))
    none = F.array().cast("array<string>")
    matches = []
    for kind, pattern, mark in KINDS:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        if kind == "card":  # sixteen digits in a row at least, or there is none
            found = F.when(F.col("text").rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), found).otherwise(none)
        elif mark:
            found = F.when(F.contains("text", F.lit(mark)), found).otherwise(none)
        matches.append(found.alias(f"m_{kind}"))
    df = df.select("*", *matches)
    df = df.select("*", *(F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"g_{k}") for k, p, _ in KINDS))
    names = [k for k, _, _ in KINDS]
    df = df.select("*", *(F.zip_with(F.slice(f"g_{k}", 1, F.size(f"m_{k}")), f"m_{k}", lambda g, m: F.length(g) + F.length(m)).alias(f"l_{k}") for k in names))

    def sums(k: str) -> Column:  # of blocks, so that many matches don't take a square of steps
        last = F.floor((F.size(f"m_{k}") - 1) / _BLOCK).cast("int")
        return F.when(F.size(f"m_{k}") > 0, F.transform(F.sequence(F.lit(0), last), lambda j: _sum(F.slice(f"l_{k}", j * _BLOCK + 1, _BLOCK))))

    df = df.select("*", *(sums(k).alias(f"b_{k}") for k in names))

    def spans(n: int, k: str) -> Column:
        def one(value: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            gap = F.get(f"g_{k}", i)
            start = _sum(F.slice(f"b_{k}", F.lit(1), block)) + _sum(F.slice(f"l_{k}", block * _BLOCK + 1, i % _BLOCK)) + F.length(gap)
            return F.struct(
                F.lit(n).alias("kind"),
                start.cast("long").alias("start"),
                (start + F.length(value)).cast("long").alias("end"),
                F.lower(value).alias("value"),
            )

        return F.filter(F.transform(f"m_{k}", one), lambda s: _valid(k, s["value"]))

    df = df.select("rid", "doc_id", "text", F.concat(*(spans(n, k) for n, k in enumerate(names))).alias("found"))
    return df.select("rid", "doc_id", "found", F.when(F.size("found") > 0, F.col("text")).alias("text"))


def _words(text: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def _places(texts: DataFrame) -> DataFrame:
    """rid, term, start, end of every term of ``texts`` (rid, text)."""
    df = texts.select("rid", F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("w"), F.split("text", TERM, -1).alias("g")).filter(F.size("w") > 0)
    df = df.select("rid", "w", "g", F.zip_with(F.slice("g", F.lit(1), F.size("w")), "w", lambda g, w: F.length(g) + F.length(w)).alias("l"))
    last = F.floor((F.size("w") - 1) / _BLOCK).cast("int")
    df = df.select("*", F.transform(F.sequence(F.lit(0), last), lambda j: _sum(F.slice("l", j * _BLOCK + 1, _BLOCK))).alias("b"))
    df = df.select("*", F.posexplode("b").alias("j", "own"))
    at = F.col("j") * _BLOCK + 1
    df = df.select("rid", _sum(F.slice("b", F.lit(1), F.col("j"))).alias("base"), F.slice("w", at, F.lit(_BLOCK)).alias("w"), F.slice("l", at, F.lit(_BLOCK)).alias("l"))

    def place(word: Column, i: Column) -> Column:
        end = F.col("base") + _sum(F.slice("l", F.lit(1), i + 1))
        return F.struct(F.lower(word).alias("term"), (end - F.length(word)).cast("long").alias("start"), end.cast("long").alias("end"))

    return df.select("rid", F.explode(F.transform("w", place)).alias("t")).select("rid", "t.*")


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """rid, term, action: the terms of a document that reveal enough of an entity in it.

    Counts are of documents, over all of them; each count is summed within tasks before it moves. Terms too frequent to
    reveal an entity even if they stood in all its documents are left out before pairs are made. Entities of one document
    have the same counts with each of its terms, so that one stands for all of them.
    """
    n = found.count()
    entities = found.select("rid", F.explode(F.array_distinct(F.transform("found", lambda f: F.struct(f["kind"], f["value"])))).alias("e"))
    entities = entities.select("rid", F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
    entities = attach_group(entities, ["kind", "value"], "rid", [F.count(F.lit(1)).alias("c")], [F.sum("c").alias("n_entity")]).filter(F.col("n_entity") < n)
    e = F.when(F.col("n_entity") > 1, F.sha2(F.concat_ws(":", "kind", "value"), 256)).otherwise(F.lit(""))
    held = materialise(entities.select("rid", e.alias("e"), "n_entity").distinct())
    most = held.agg(F.max("n_entity")).first()[0]
    if most is None:
        return found.select("rid", F.lit("").alias("term"), F.lit(0).alias("action")).filter("false")
    words = docs.select(F.explode(F.array_distinct(_words(text_of("text")))).alias("term"))
    n_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))

    def share(both: Column, n_entity: Column) -> Column:
        of_term = (both + PRIOR * n_entity / float(n)) / (F.col("n_term") + PRIOR)
        return 1 + F.log(of_term) / F.log(F.lit(float(n)) / n_entity)

    n_term = n_term.filter(share(F.least(F.lit(most), "n_term"), F.lit(most)) >= GENERALISE)
    terms = found.filter(F.size("found") > 0).select("rid", F.explode(F.array_distinct(_words("text"))).alias("term"))
    pairs = terms.join(n_term, "term").join(held, "rid").filter(share(F.least("n_entity", "n_term"), F.col("n_entity")) >= GENERALISE)
    many = attach_group(pairs.filter("n_entity > 1"), ["e", "term"], "rid", [F.count(F.lit(1)).alias("c")], [F.sum("c").alias("both")])
    one = pairs.filter("n_entity = 1").withColumn("both", F.lit(1).cast("long"))
    known = many.unionByName(one).withColumn("share", share(F.col("both"), F.col("n_entity"))).filter(F.col("share") >= GENERALISE)
    return known.groupBy("rid", "term").agg(F.max(F.when(F.col("share") >= REMOVE, 1).otherwise(0)).cast("int").alias("action"))


def _joined(spans: Column, names: tuple[str, ...]) -> Column:
    name = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points, those of the four base kinds first, then terms to generalise and to
    remove; a term never overlaps a base span. Null and empty texts have none. Repeated rows are treated alike and
    count as documents of their own. No rows give no rows. Other columns are ignored.
    """
    found = materialise(find_entities(docs))
    act = materialise(disclosing(docs, found))
    texts = found.join(act.select("rid").distinct(), "rid", "left_semi").select("rid", "text")
    hits = _places(texts).join(act, ["rid", "term"])
    hits = hits.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct((F.col("action") + len(KINDS)).alias("kind"), "start", "end"))).alias("hits")
    )
    rows = found.drop("text").join(hits.withColumnRenamed("rid", "r"), F.col("rid") == F.col("r"), "left")
    base = F.transform("found", lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    rows = rows.select("doc_id", base.alias("base"), F.coalesce("hits", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")).alias("hits"))
    apart = F.filter("hits", lambda h: ~F.exists("base", lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"])))
    names = tuple(k for k, _, _ in KINDS)
    rows = rows.select("doc_id", "base", _joined(F.col("base"), names).alias("text"), _joined(F.concat("base", apart), names + ADDED).alias("spans"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")

    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(names)]
    return rows.select("doc_id", *counts, F.sha2("text", 256).alias("base_sha256"), "spans")


def sanitise(text: Column, spans: Column) -> Column:
    """``text`` with the places in ``spans`` (as ``find_personal_data`` gives them) replaced.

    Entities become their kind in brackets; removed terms go; generalised ones keep no more than that a word stood there.
    Where base spans overlap, the earlier one is replaced and the rest of the other with it.
    """
    parts = F.filter(F.split(spans, ","), lambda s: s != "")
    place = F.transform(parts, lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end"), F.split(s, ":")[0].alias("kind")))
    shown = lambda k: F.when(k == "remove", F.lit("")).when(k == "generalise", F.lit("[WORD]")).otherwise(F.concat(F.lit("["), F.upper(k), F.lit("]")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        out = F.when(new, F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), shown(s["kind"]))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    return F.aggregate(F.array_sort(place), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
