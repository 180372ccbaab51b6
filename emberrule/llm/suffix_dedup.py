"""Removal of repeated byte strings by hash-compared suffix sorting.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id. Suffixes are compared by
prefix polynomial hashes: a binary search over lengths finds how far two suffixes agree, so that a
comparison takes a few steps whatever the texts. They are sorted by merging, and where neighbours agree by their
hashes their bytes are compared as well.

Only suffixes that can matter are sorted. Each window of 50 bytes names one of its 16-byte strings, the one of
least hash; equal windows name equal strings. The consecutive windows of a document that name the same place are a
run. (1) Runs go to the task of their string: runs that are equal need no sorting, the later documents' are marked.
Within a block of texts their bytes are compared; between blocks runs count as equal if their string's hash, 32 bits and
those that chose its task, and another one of 64 bits of the whole run agree. (2) Where different runs share a string, one of each
kind is asked for its bytes, and their windows' suffixes are sorted. Windows of a string of very many runs meet by the bytes
beside it as well, so that no task gets them all. (3) Marks go back to the documents. Every window is in exactly one run,
so none is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_plans, materialise, small_batches, text_of
from .fingerprints import mix64

#: Bytes in a repeated string, and in the strings by which windows meet.
LENGTH, NAME = 50, 16
#: Bytes of text that are worked on at once.
BLOCK = 2_000_000
#: Runs of a string from which its windows meet by the bytes beside it as well.
HOT = 4096
#: Bytes of input for each task at most, about, where the planner knows the size.
TASK = 16_000_000
#: The id that stands for null, the last of all.
LAST = 2**63 - 1

_MULTIPLIER = 0xD1342543DE82EF95
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    m = 1
    while m < n:
        k = min(m, n - m)
        out[m : m + k] = out[:k] * np.uint64(pow(base, m, 2**64))
        m *= 2
    return out


class PrefixHashes:
    """Hashes of any substring of ``data`` from those of its prefixes, modulo 2**64, letters spread at random."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(12, int(len(data) + 1).bit_length())
        self.inverse = _powers(pow(_MULTIPLIER, -1, 2**64), size)
        self.upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[data] * _powers(_MULTIPLIER, size)[: len(data)], out=self.upto[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.upto[end] - self.upto[start]) * self.inverse[start]

    def all_of(self, n: int) -> np.ndarray:
        return (self.upto[n:] - self.upto[:-n]) * self.inverse[: len(self.upto) - n]


def common(hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes the suffixes at a and b agree in, up to ``most``; binary search over lengths."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = hashes.of(a, a + mid) == hashes.of(b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_order(data: np.ndarray, hashes: PrefixHashes, segment: np.ndarray, start: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Positions of ``start`` in the order of their suffixes' first ``most`` bytes, within each segment.

    ``segment`` is in ascending order. A mergesort of all segments at once: in each pass every suffix finds its
    rank in the neighbouring sorted part by binary search.
    """
    n = len(start)
    order = np.arange(n)
    first = np.searchsorted(segment, segment, side="left")
    size = np.searchsorted(segment, segment, side="right") - first
    place = order - first
    width, widest = 1, int(size.max()) if n else 0
    eight = np.zeros(n, np.uint64)  # the first bytes as a number, which settle most comparisons
    for i in range(8):
        eight = (eight << np.uint64(8)) | data[start + i]
    while width < widest:
        part = place // width
        other = (part ^ 1) * width
        low = np.minimum(other, size)
        high = np.minimum(other + width, size)
        base = low.copy()
        right = (part & 1).astype(bool)
        at, head = start[order], eight[order]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            beside = first[open_] + mid
            before = head[beside] < head[open_]
            tie = np.flatnonzero(head[beside] == head[open_])
            mine, theirs = at[open_[tie]], at[beside[tie]]
            agree = common(hashes, theirs, mine, most)
            last = np.minimum(agree, most - 1)
            less = data[theirs + last] < data[mine + last]
            before[tie] = np.where(agree == most, right[open_[tie]], less)  # equal ones keep their order
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        target = first + (part // 2) * 2 * width + (place - part * width) + (low - base)
        order[target] = order.copy()
        width *= 2
    return order


def equal_windows(data: np.ndarray, segment: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(positions sorted, class of each): windows of a segment are in one class if all their bytes are equal."""
    hashes = PrefixHashes(data)
    order = suffix_order(data, hashes, segment, start, length)
    at, seg = start[order], segment[order]
    same = np.zeros(len(at), bool)
    if len(at) > 1:
        same[1:] = (seg[1:] == seg[:-1]) & (common(hashes, at[:-1], at[1:], length) == length)
    check = np.flatnonzero(same)
    windows = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else None
    for i in range(0, len(check), 100_000):
        c = check[i : i + 100_000]
        if not (windows[at[c]] == windows[at[c - 1]]).all():  # two strings share all hashes: sort by the bytes
            rows = np.concatenate([seg.astype(">u8").view(np.uint8).reshape(len(seg), 8), windows[at]], axis=1)
            _, label = np.unique(np.ascontiguousarray(rows).view(f"V{8 + length}").ravel(), return_inverse=True)
            by = np.argsort(label, kind="stable")
            return order[by], label[by]
    return order, np.cumsum(~same) - 1


# Blocks of columns travel as compressed bytes, each byte place together.
_COLUMNS = (("name", "<u4"), ("run", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("low", "<u4"), ("more", "<u1"))


def _write(columns: dict[str, np.ndarray], kinds: tuple = _COLUMNS) -> bytes:
    n = len(columns[kinds[0][0]])
    parts = [np.array([n], "<i8").tobytes()]
    for name, kind in kinds:
        parts.append(np.ascontiguousarray(columns[name].astype(kind).view(np.uint8).reshape(n, -1).T).tobytes())
    return b"".join(parts)


def _read(blob: bytes, kinds: tuple = _COLUMNS) -> tuple[dict[str, np.ndarray], int]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    out, at = {}, 8
    for name, kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n)
        out[name] = np.ascontiguousarray(planes.T).view(kind).ravel()
        at += n * width
    return out, at


def _read_all(blobs: Iterator[bytes], kinds: tuple = _COLUMNS) -> dict[str, np.ndarray]:
    read = [_read(zstandard.decompress(b), kinds)[0] for b in blobs]
    return {name: np.concatenate([r[name] for r in read]) for name, _ in kinds}


def runs_of(texts: list[bytes], length: int = LENGTH, name: int = NAME) -> dict[str, np.ndarray]:
    """The runs of some texts: name, run (hash of all its bytes), row (text's number), low and high (first and last start)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    if len(data) < length:
        return {k: np.zeros(0, np.int64) for k in ("name", "run", "row", "low", "high")}
    hashes = PrefixHashes(data)
    spread = mix64(hashes.all_of(name))
    place = np.arange(len(spread), dtype=np.uint64)
    least = (spread & ~np.uint64(63)) | (place & np.uint64(63))  # a window has fewer than 64 places
    width, have = length - name + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    starts = np.maximum(sizes - length + 1, 0)
    row = np.repeat(np.arange(len(texts)), starts)
    s = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(begin, starts)
    chosen = least[s]
    new = np.ones(len(s), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    low, high = s[at], s[np.concatenate([at[1:] - 1, [len(s) - 1]]) if len(at) else at]
    run = mix64(hashes.of(low, high + length) + mix64((high - low).astype(np.uint64)))
    return {"name": chosen[at] >> np.uint64(6), "run": run, "row": row[at], "low": low - begin[row[at]], "high": high - begin[row[at]]}


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of ``size`` bytes at a and b are equal, byte by byte."""
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 10_000):
        n = size[i : i + 10_000]
        step = np.arange(int(n.max()))
        inside = step < n[:, None]
        x, y = (np.minimum(p[i : i + 10_000, None] + step, len(data) - 1) for p in (a, b))
        out[i : i + 10_000] = ((data[x] == data[y]) | ~inside).all(axis=1)
    return out


def beside(data: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parts (run, low, high, name) of runs of ``data``, named by the 16 bytes before their string, or after it, as well.

    A window's string is the leftmost of its least; those with 16 bytes before it go by these, the others have 16 behind.
    """
    hashes = PrefixHashes(data)
    place = mix64(hashes.all_of(NAME)) >> np.uint64(6)
    count = high - low + 1
    run = np.repeat(np.arange(len(name)), count)
    s = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    at = np.empty(len(s), np.int64)
    for i in range(0, len(s), 50_000):
        at[i : i + 50_000] = s[i : i + 50_000] + place[s[i : i + 50_000, None] + np.arange(LENGTH - NAME + 1)].argmin(axis=1)
    after = s > at - NAME
    new = np.ones(len(s), bool)
    new[1:] = (run[1:] != run[:-1]) | (at[1:] != at[:-1]) | (after[1:] != after[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(s)]])[: len(first)] - 1
    side = np.where(after[first], at[first] + NAME, at[first] - NAME)
    key = mix64(name[run[first]].astype(np.uint64) * np.uint64(2) + after[first].astype(np.uint64)) + hashes.of(side, side + NAME)
    return run[first], s[first], s[last], (mix64(key) >> np.uint64(1)).astype(np.int64)


MARKS = "name long, doc long, tag long, low int, high int"  # name -1: a mark, else a run whose bytes are asked for; odd: of a hot string


def _frame(name: np.ndarray, doc: np.ndarray, tag: np.ndarray, low: np.ndarray, high: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"name": name, "doc": doc, "tag": tag, "low": low.astype(np.int32), "high": high.astype(np.int32)})


def _blocks(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[list[list]]:
    """Rows of batches by blocks of about BLOCK bytes of text, the first column."""
    held: list[list] = [[] for _ in columns]
    size = 0
    for b in batches:
        for values in zip(*(b[c] for c in columns), strict=True):
            for h, v in zip(held, values, strict=True):
                h.append(v)
            size += len(values[0])
            if size >= BLOCK:
                yield held
                held, size = [[] for _ in columns], 0
    if held[0]:
        yield held


def _first_round(rows: DataFrame, buckets: int) -> DataFrame:
    """Marks and questions of all documents."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts, docs, tags in _blocks(batches, "text", "doc", "tag"):
            raw = [t.encode() for t in texts]
            r = runs_of(raw)
            doc, tag = np.array(docs, np.int64)[r["row"]], np.array(tags, np.int64)[r["row"]]
            # Of runs that are equal within the block only the first document's travel.
            order = np.lexsort((doc, r["run"]))
            run = r["run"][order]
            new = np.ones(len(run), bool)
            new[1:] = run[1:] != run[:-1]
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))]
            late = doc[order] > doc[head]
            begin = np.cumsum([0, *map(len, raw)])[r["row"]] + r["low"]
            size = r["high"] - r["low"] + LENGTH
            mine, first = order[late], head[late]
            equal = size[mine] == size[first]
            equal[equal] = same_bytes(np.frombuffer(b"".join(raw), np.uint8), begin[mine[equal]], begin[first[equal]], size[mine[equal]])
            late[late] = equal
            bucket = (r["name"] >> np.uint64(32)).astype(np.int64) % buckets if len(run) else np.zeros(0, np.int64)
            out = []
            for chosen, known in ((order[~late], False), (order[late], True)):
                chosen = chosen[np.argsort(bucket[chosen], kind="stable")]
                cuts = np.flatnonzero(np.diff(bucket[chosen], prepend=-1))
                for part in np.split(chosen, cuts[1:]) if len(chosen) else []:
                    c = {"name": r["name"][part] & np.uint64(0xFFFFFFFF), "run": r["run"][part], "doc": doc[part], "tag": tag[part], "low": r["low"][part], "more": (r["high"] - r["low"])[part]}
                    out.append((int(bucket[part[0]]), known, zstandard.compress(_write(c), 1)))
            yield pd.DataFrame(out, columns=["bucket", "known", "blob"])

    def meet(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        frames = []
        known = b["known"].to_numpy(bool)
        if known.any():
            k = _read_all(b["blob"][known])
            frames.append(_frame(np.full(len(k["doc"]), -1), k["doc"], k["tag"], k["low"], k["low"].astype(np.int64) + k["more"]))
        if not known.all():
            c = _read_all(b["blob"][~known])
            c["high"] = c["low"].astype(np.int64) + c.pop("more")
            order = np.lexsort((c["doc"], c["run"], c["name"]))
            c = {k: v[order] for k, v in c.items()}
            new_name = np.ones(len(order), bool)
            new_name[1:] = c["name"][1:] != c["name"][:-1]
            new = new_name.copy()
            new[1:] |= c["run"][1:] != c["run"][:-1]
            head = c["doc"][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            late = c["doc"] > head
            group = np.cumsum(new_name) - 1
            kinds = np.bincount(group, new)[group]
            asked = ~late & (kinds > 1)
            frames.append(_frame(np.full(int(late.sum()), -1), c["doc"][late], c["tag"][late], c["low"][late], c["high"][late]))
            name = (c["name"][asked].astype(np.int64) * buckets + key[0]) * 2 + (kinds[asked] > HOT)
            frames.append(_frame(name, c["doc"][asked], c["tag"][asked], c["low"][asked], c["high"][asked]))
        return pd.concat(frames, ignore_index=True)

    sent = rows.mapInPandas(send, "bucket int, known boolean, blob binary")
    return sent.groupBy("bucket").applyInPandas(meet, MARKS)


_ASKED = (("name", "<i8"), ("doc", "<i8"), ("tag", "<i8"), ("low", "<u4"), ("size", "<u4"))


def _second_round(rows: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """Marks from sorting the windows of different runs with one name."""
    span = F.col("low").cast("long") + F.shiftleft((F.col("high") - F.col("low")).cast("long"), 32)
    lists = asked.groupBy("doc", "tag").agg(F.collect_list(F.struct("name", span.alias("span"))).alias("asked"))
    found = rows.join(lists, ["doc", "tag"]).select("doc", "tag", "text", *(F.col(f"asked.{f}").alias(f) for f in ("name", "span")))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts, docs, tags, names, spans in _blocks(batches, "text", "doc", "tag", "name", "span"):
            raw = [t.encode() for t in texts]
            data = np.frombuffer(b"".join(raw), np.uint8)
            counts = np.array([len(x) for x in names])
            begin = np.repeat(np.cumsum([0, *map(len, raw)])[:-1], counts)
            name, span = np.concatenate(names).astype(np.int64), np.concatenate(spans).astype(np.int64)
            low, high = span & 0xFFFFFFFF, (span & 0xFFFFFFFF) + (span >> 32)
            doc, tag = np.repeat(np.array(docs, np.int64), counts), np.repeat(np.array(tags, np.int64), counts)
            hot = np.flatnonzero(name & 1)
            if len(hot):
                run, one, two, other = beside(data, name[hot], begin[hot] + low[hot], begin[hot] + high[hot])
                run, rest = hot[run], np.setdiff1d(np.arange(len(name)), hot)
                one, two = one - begin[run], two - begin[run]
                name, low, high = (np.concatenate([x[rest], y]) for x, y in ((name, other), (low, one), (high, two)))
                doc, tag, begin = (np.concatenate([x[rest], x[run]]) for x in (doc, tag, begin))
            size = high - low + LENGTH
            bucket = (mix64(name.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            out = []
            for part in np.split(order, cuts[1:]):
                n = size[part]
                where = np.repeat(begin[part] + low[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                c = {"name": name[part], "doc": doc[part], "tag": tag[part], "low": low[part], "size": n}
                out.append((int(bucket[part[0]]), zstandard.compress(_write(c, _ASKED) + data[where].tobytes(), 3)))
            yield pd.DataFrame(out, columns=["bucket", "blob"])

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        read = [(*_read(x, _ASKED), x) for x in map(zstandard.decompress, b["blob"])]
        c = {k: np.concatenate([r[0][k] for r in read]) for k, _ in _ASKED}
        data = np.concatenate([np.frombuffer(x, np.uint8, offset=at) for _, at, x in read])
        size = c["size"].astype(np.int64)
        begin = np.cumsum(size) - size
        count = size - LENGTH + 1
        piece = np.repeat(np.arange(len(size)), count)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        start = begin[piece] + offset
        # Windows whose hash no other document's window has needn't be sorted.
        key = mix64(PrefixHashes(data).of(start, start + LENGTH))
        doc = c["doc"][piece]
        order = np.lexsort((doc, key))
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        group = np.cumsum(new) - 1
        least = doc[order][np.flatnonzero(new)] if len(order) else doc
        more = np.zeros(int(new.sum()), bool)
        np.logical_or.at(more, group[doc[order] > least[group]], True)
        chosen = order[more[group]]
        name = c["name"][piece[chosen]]
        by = np.argsort(name, kind="stable")
        chosen, name = chosen[by], name[by]
        if not len(chosen):
            return _frame(*(np.zeros(0, np.int64),) * 5)
        _, segment = np.unique(name, return_inverse=True)
        sorted_, label = equal_windows(data, segment.astype(np.int64), start[chosen])
        chosen = chosen[sorted_]
        d = doc[chosen]
        lowest = np.full(int(label.max()) + 1, LAST, np.int64)
        np.minimum.at(lowest, label, d)
        hit = chosen[d > lowest[label]]
        low = c["low"][piece[hit]].astype(np.int64) + offset[hit]
        return _frame(np.full(len(hit), -1), doc[hit], c["tag"][piece[hit]], low, low)

    sent = found.mapInPandas(send, "bucket int, blob binary")
    return sent.groupBy("bucket").applyInPandas(meet, MARKS)


def cut(text: bytes, lows: np.ndarray, highs: np.ndarray, length: int = LENGTH) -> tuple[bytes, int, int]:
    """What stays of ``text``, how many bytes go, and in how many spans."""
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, lows, 1)
    np.add.at(change, highs + length, -1)
    gone = np.cumsum(change)[:-1] > 0
    spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are their UTF-8 bytes; null and empty texts, and those below 50 bytes, lose nothing. Rows with the same id don't
    count as earlier than each other; null ids are one id, the last. No rows give no rows. Other columns are ignored.
    Where ids repeat, rows are numbered and written once, so that each row's marks come back to it.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text_of("text").alias("text"))
    repeated = not rows.groupBy("doc").count().filter("count > 1").isEmpty()
    tag = F.monotonically_increasing_id() if repeated else F.lit(0).cast("long")
    rows = materialise(rows.withColumn("tag", tag)) if repeated else rows.withColumn("tag", tag)
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of files, or far too much where it isn't known
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(buckets, min(known // TASK, 2**20) if known < 2**56 else 0)
    long = rows.filter(F.octet_length("text") >= LENGTH).select("text", "doc", "tag")
    with small_batches(spark):
        first = materialise(_first_round(long, buckets))
        free_plans(spark)
        second = materialise(_second_round(long, first.filter("name >= 0"), 4 * buckets))
        free_plans(spark)
    marks = first.filter("name = -1").unionByName(second).groupBy("doc", "tag").agg(
        F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")
    )

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, lows, highs in zip(b["doc_id"], b["text"], b["lows"], b["highs"], strict=True):
                raw = text.encode()
                kept, gone, spans = (raw, 0, 0) if lows is None else cut(raw, np.asarray(lows, np.int64), np.asarray(highs, np.int64))
                out.append((doc_id, len(raw), gone, spans, hashlib.sha256(kept).hexdigest()))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    joined = rows.join(marks, ["doc", "tag"], "left").select("doc_id", "text", "lows", "highs")
    with small_batches(spark):
        return materialise(joined.mapInPandas(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
