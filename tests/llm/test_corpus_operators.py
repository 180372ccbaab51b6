"""Each operator against a plain version on small tables that hold nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberrule.llm import common, exact_dedup, fingerprints, html_text, mixing, near_dedup, packing, pii, suffix_dedup, token_counts, toxicity
from emberrule.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, rid long, digest string, kept boolean, rank double, part int, score double, cls string, n long, size long, bucket int, label string, __h string"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def texts():
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base), (2, base), (3, "  " + base.replace(" ", "\n")), (4, " ".join(near)), (5, words(2, 200)), (6, None), (7, ""), (8, " \t"), (9, words(3, 3)), (10, words(4, 20_000)),
        (10, words(4, 20_000)), (11, "é😀 " * 40 + base[:80]), (None, base), (None, words(5, 30)), (12, "the " * 300), (13, "a@b.co +1 555 123 4567 10.0.0.1 4111 1111 1111 1111 <|endoftext|> x"), (14, "x" * 5000), (15, words(2, 200)[100:400]),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, "en" if i else None, None if i in (5, 6) else f"s{(i or 0) % 3}", 1, 7, "d", None, 0.5, 3, 0.1, "c", 2, 3, 4, "l", "h") for i, t in texts()]
    return spark.createDataFrame(data, CLASHING)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def by_id(rows):
    return sorted(rows, key=repr)


def test_exact_dedup(docs, empty):
    def plain():
        groups = collections.defaultdict(list)
        for i, t in texts():
            groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
        out = []
        for t, g in groups.items():
            keep = min(g)[3]
            sha = hashlib.sha256(t.encode()).hexdigest()
            out += [(i, keep, len(g), sha) for *_, i in g]
        return by_id(out)

    for digest in (exact_dedup.digest64, lambda c: exact_dedup.digest64(c) % 3):  # the second makes many chunks share a digest
        got = exact_dedup.exact_dedup(docs, digest=digest).collect()
        assert by_id((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == plain()
        assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_mixing(docs, empty, spark):
    got = mixing.mix_sources(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert by_id((r["doc_id"], r["size"]) for r in got) == by_id((i, size(t)) for i, t in texts())
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] and r["taken"] <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    targets = {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert sum(t for _, t in targets.values()) == pytest.approx(total)
    assert all(t <= 3 * s for s, t in targets.values())
    assert by_id(got) == by_id(mixing.mix_sources(docs).collect())
    assert mixing.mix_sources(empty).count() == 0
    many = [(i, words(i, 5 + i % 40), f"s{i % 7 if i % 3 else 0}") for i in range(600)] + [(i, None, None) for i in range(600, 610)]
    got = mixing.mix_sources(spark.createDataFrame(many, "doc_id long, text string, source string")).collect()
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 5, s
    small = [(1, "a b", "x"), (2, "c", "y")]
    assert mixing.mix_sources(spark.createDataFrame(small, "doc_id long, text string, source string")).count() == 2


def test_mixing_draws_by_odds(spark):
    """Of a source half of whose words are wanted the longer texts are likelier, and those too long for a chance below one are certain."""
    rows = [(i, " ".join(["w"] * (1 if i % 2 else 16)), "a") for i in range(20_000)] + [(90_000, " ".join(["w"] * 9000), "a")]
    rows += [(100_000 + i, " ".join(["v"] * 10), s) for s in ("b", "c") for i in range(1500)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("source = 'a'").collect()
    size, target = got[0]["source_size"], got[0]["target"]
    assert 0 < target < size
    taken = {n: sum(r["copies"] for r in got if r["size"] == n) / sum(r["size"] == n for r in got) for n in (1, 16, 9000)}
    assert taken[9000] == 1 and taken[16] > 2 * taken[1] > 0
    rest = target - 9000
    level = rest / (10_000 * 1 * 1 + 10_000 * 16 * 4)
    assert taken[1] == pytest.approx(level, rel=0.15) and taken[16] == pytest.approx(4 * level, rel=0.08)  # three standard deviations
    assert abs(sum(r["taken"] for r in got) - target) <= 8


def test_mixing_without_broadcast(docs, monkeypatch):
    want = by_id(mixing.mix_sources(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert by_id(mixing.mix_sources(docs).collect()) == want


def test_token_counts(docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = by_id((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts())
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = token_counts.count_tokens(docs, path, cache).collect()
        assert by_id((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    stored = docs.sparkSession.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()  # the second run encoded nothing
    assert token_counts.count_tokens(empty, path).count() == 0


def test_token_counter_on_odd_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        count = token_counts.Counter(f.read())
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz'ABCéüßŉſİ0123½ .,!?-\n\t\x0b\x1c\x85\xa0_#²ªΣς中"
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)
    for other in ("byte_bpe_50k.json",):
        with open(public_tokenizers.path(other), encoding="utf-8") as f:
            assert token_counts.Counter(f.read())("Hello there") == len(Tokenizer.from_file(public_tokenizers.path(other)).encode("Hello there", add_special_tokens=False).ids)


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    want = []
    for i, t in texts():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        bounds = [0, *range(first, len(ids) + 1, 2048)]
        for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want.append((i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert by_id((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == by_id(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_each_piece_once_and_packs_tightly(seed):
    rng = random.Random(seed)
    counts = collections.Counter(min(2048, int(rng.lognormvariate(5, 1.2)) + 1) for _ in range(5000))
    patterns, bins = packing.plan_bins(dict(counts))
    used = collections.Counter()
    for use, times in patterns:
        assert sum(x * n for x, n in use.items()) <= 2048 and times > 0
        for x, n in use.items():
            used[x] += n * times
    assert used == counts
    assert bins <= 1.01 * sum(x * n for x, n in counts.items()) / 2048 + 2


def test_a_bins_smallest_piece_gives_way_to_two():
    patterns, bins = packing.plan_bins({60: 1, 30: 2, 20: 1, 21: 1, 19: 1, 15: 1}, 100)
    assert sum(t for _, t in patterns) == bins
    assert patterns[0][0] == {60: 1, 21: 1, 19: 1}  # not 60 + 30


def test_fingerprints(docs, empty, spark):
    def plain(rows):
        hashes = fingerprints.WordHashes()
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        out = []
        for n, (i, t) in enumerate(rows):
            t, after = t or "", rows[(n + 1) % len(rows)][1] or ""
            half = len(t) // 2
            changed = t[: len(t) - half] + after[:half]
            sketch = [np.unique(fingerprints.shingle_hashes(x, hashes))[:256] for x in (t, changed)]
            out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), *map(fingerprints.encode, sketch)))
        return by_id(out)

    for rows, df in ((texts(), docs), ([(1, "only one")], spark.createDataFrame([(1, "only one")], "doc_id long, text string"))):
        got = fingerprints.fingerprint_documents(df).collect()
        assert by_id(tuple(r[:5]) for r in got) == plain(rows)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_sketches_estimate_and_merge():
    hashes = fingerprints.WordHashes()
    a, b = (set(words(s, 3000).split()) for s in (1, 2))
    text = {k: " ".join(sorted(v)) for k, v in {"a": a, "b": b}.items()}
    h = {k: fingerprints.shingle_hashes(t, hashes, 1) for k, t in text.items()}
    s = {k: fingerprints.bottom(v) for k, v in h.items()}
    assert abs(fingerprints.resemblance(s["a"], s["b"]) - len(a & b) / len(a | b)) < 0.1
    assert abs(fingerprints.distinct(s["a"]) / len(a) - 1) < 0.2
    assert abs(fingerprints.containment(s["a"], s["b"]) - len(a & b) / len(a)) < 0.15
    assert (fingerprints.merge(s["a"], s["b"]) == fingerprints.bottom(np.concatenate([h["a"], h["b"]]))).all()
    assert (fingerprints.decode(fingerprints.encode(s["a"])) == s["a"]).all()


def plain_near(rows, least=0.8):
    """Groups by comparing every pair."""
    hashes = fingerprints.WordHashes()
    runs = [near_dedup.labelled_runs(t or "", hashes) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.aligned(runs[i], runs[j], least) >= least:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return by_id((i, min(g, key=lambda x: (x is None, x or 0)), len(g)) for g in groups.values() for i in g)


def variants(base, n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = base.split()
        w[rng.randrange(len(w))] = f"new{i}"
        out.append(" ".join(w))
    return out


def test_near_dedup(docs, empty, spark):
    got = near_dedup.near_dedup(docs).collect()
    assert by_id((r["doc_id"], r["group_id"], r["group_size"]) for r in got) == plain_near(texts())
    assert sum(r["kept"] for r in got) == len({r["group_id"] for r in got} - {None}) + any(r["group_id"] is None for r in got)
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_of_large_groups_and_shared_passages(spark):
    passage = words(99, 60)
    rows = [t for s in range(3) for t in variants(words(s, 150), 60, s)]  # groups beyond FEW
    rows += [f"{words(1000 + i, 30)} {passage} {words(2000 + i, 30)}" for i in range(120)]  # alike in a passage only
    rows += variants(words(50, 12), 3, 1)
    random.Random(1).shuffle(rows)
    rows = list(enumerate(rows))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_id((r["doc_id"], r["group_id"], r["group_size"]) for r in got) == plain_near(rows)


def sparse_group():
    """Texts of one origin most of whose similarities lie near 0.8: many large buckets, few links in each."""
    origin, rng, rows = words(7, 600).split(), random.Random(11), []
    for i in range(300):
        w = list(origin)
        for j in rng.sample(range(600), 8):
            w[j] = f"own{i}x{j}"
        rows.append((i, " ".join(w)))
    return rows


def test_near_dedup_loses_no_link_in_large_buckets_of_sparse_links(spark):
    rows = sparse_group()
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_id((r["doc_id"], r["group_id"], r["group_size"]) for r in got) == plain_near(rows)


def test_near_dedup_of_drifting_versions_and_a_group_of_a_third(spark):
    rng, version, rows = random.Random(3), words(8, 300).split(), []
    for i in range(400):  # each version changes the one before: few are like any one leader
        for j in rng.sample(range(300), 2):
            version[j] = f"v{i}x{j}"
        rows.append(" ".join(version))
    rows += variants(words(9, 80), 300, 4) + [words(5000 + i, 60) for i in range(200)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_id((r["doc_id"], r["group_id"], r["group_size"]) for r in got) == plain_near(rows)


def test_near_dedup_leaders_and_settled_rows_stay_in_the_search(spark):
    members = spark.createDataFrame([(b, r, 10, 100 - r, b) for b in range(6) for r in range(40) if r % 6 != b], "bucket long, rep long, n long, score long, band int")
    assert {r["rep"] for r in near_dedup._open(members, None, 0).select("leader.rep").distinct().collect()} == {0, 1}
    stars = near_dedup._stars(near_dedup._open(members, None, 1), 0.8).collect()
    assert len(stars) <= 40 * near_dedup.LEADERS and {x for r in stars for x in r} == set(range(40))
    keys = spark.createDataFrame([(r, [r % 3] * 20) for r in range(40)], "rep long, keys array<long>")
    deep = near_dedup._deeper(members, keys, 2)
    assert deep.select("bucket").distinct().count() == 18 and deep.groupBy("bucket").agg(F.max(F.col("rep") % 3) - F.min(F.col("rep") % 3)).filter("`(max((rep % 3)) - min((rep % 3)))` > 0").isEmpty()
    whole = spark.createDataFrame([(i, 0) for i in range(1, 40)], "node long, root long")
    assert near_dedup._open(members, whole, 1).count() == 0  # buckets of one group are done
    assert near_dedup._open(members, whole.filter("node < 39"), 1).filter("bucket <> 3").count() == members.filter("bucket <> 3").count()
    leader = np.arange(1, 101, dtype=np.uint64)
    settled, other = (np.concatenate([np.arange(at, 101, dtype=np.uint64), own + np.arange(at - 1, dtype=np.uint64)]) for at, own in ((10, 1000), (16, 1000)))
    assert near_dedup.aligned(leader, settled) >= 0.8 > near_dedup.aligned(leader, other) and near_dedup.aligned(settled, other) >= 0.8
    runs = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate((leader, settled, other))], "rep long, runs binary")
    reps = spark.createDataFrame([(0, 100, 0), (1, 100, 0), (2, 100, 2)], "rep long, n long, root long")
    got = {(r["a"], r["b"]) for r in near_dedup._across(reps, runs, 0.8).collect()}
    assert (1, 2) in got and (0, 1) not in got


def test_pairs_of_one_text_are_dealt(spark):
    pairs = spark.createDataFrame([(0, i) for i in range(1, 1000)], "a long, b long")
    sizes = near_dedup._dealt(pairs, "a", "b").groupBy("a", "part_a").count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 2 * near_dedup.PIECE
    assert near_dedup._dealt(pairs, "b", "a").filter("part_b <> 0").isEmpty()


def test_near_dedup_misses_no_pair_of_short_texts():
    hashes = fingerprints.WordHashes()
    for seed in range(600):
        w = words(seed, 9).split()
        a, b = (near_dedup.labelled_runs(" ".join(x), hashes) for x in (w[:8], w))
        assert near_dedup.aligned(a, b) >= 0.8 and np.intersect1d(near_dedup.bucket_keys(a), near_dedup.bucket_keys(b)).size


def test_alignment_is_the_longest_common_order():
    rng = random.Random(5)
    for _ in range(200):
        a = np.unique(np.array([rng.randrange(60) for _ in range(40)], np.uint64))
        rng.shuffle(a_list := a.tolist())
        a = np.array(a_list, np.uint64)
        b_list = [x for x in a_list if rng.random() > 0.1]
        for _ in range(rng.randrange(3)):
            b_list.insert(rng.randrange(len(b_list) + 1), 100 + rng.randrange(1000))
        if rng.random() < 0.5:
            i, j = rng.randrange(len(b_list)), rng.randrange(len(b_list))
            b_list[i], b_list[j] = b_list[j], b_list[i]
        b = np.array(list(dict.fromkeys(b_list)), np.uint64)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        n = table[-1, -1]
        true = n / (len(a) + len(b) - n)
        assert near_dedup.aligned(a, b) == (pytest.approx(true) if true >= 0.8 else 0.0)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def plain_removal(rows, length=50):
    out = []
    for i, t in rows:
        mine = (t or "").encode()
        rank = lambda x: (x is None, x or 0)
        earlier = {e[s : s + length] for j, u in rows if rank(j) < rank(i) for e in [(u or "").encode()] for s in range(len(e) - length + 1)}
        gone = np.zeros(len(mine), bool)
        for s in range(len(mine) - length + 1):
            if mine[s : s + length] in earlier:
                gone[s : s + length] = True
        kept = bytes(c for c, g in zip(mine, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((i, len(mine), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return by_id(out)


def test_suffix_dedup(docs, empty, spark):
    short = [(i, t if t is None or len(t) < 20_000 else t[:3000]) for i, t in texts()]
    passage = words(7, 25)
    rng = random.Random(4)
    more = [(100 + i, words(300 + i, 20) + passage[rng.randrange(40) :] + words(400 + i, 20)) for i in range(30)]
    more += [(200 + i, "ab" * rng.randrange(20, 90)) for i in range(8)] + [(300, passage[:50]), (301, passage[:49]), (302, passage[1:51])]
    rows = short + more
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_id(map(tuple, got)) == plain_removal(rows)
    assert suffix_dedup.suffix_dedup(docs).count() == len(texts())
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_of_repeated_ids(spark):
    passage = words(7, 25)
    texts_ = [f"{words(i, 12)} {passage[i % 9 :]} {words(i // 2, 9)}" for i in range(1000)]
    rows = [(1, passage), *((None, t) for t in texts_), (None, texts_[0]), (2, texts_[3]), (2, passage + "x"), (2, passage + "x")]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    rank = lambda i: (i is None, i or 0)
    seen = {i: {w for j, t in rows if rank(j) < rank(i) for e in [t.encode()] for w in (e[s : s + 50] for s in range(len(e) - 49))} for i in (1, 2, None)}
    want = []
    for i, t in rows:
        raw, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for s in range(len(raw) - 49):
            if raw[s : s + 50] in seen[i]:
                gone[s : s + 50] = True
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        want.append((i, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(kept).hexdigest()))
    assert by_id(map(tuple, got)) == by_id(want)


def test_suffix_dedup_of_a_string_of_many_runs(spark):
    rng, hot = random.Random(8), "sixteen bytes of it"
    rows = [(i, f"{words(i % 150, 8)} {hot} {words(i % 170, 8)}") for i in range(900)] + [(1000 + i, "abab" * rng.randrange(13, 30) + hot) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_id(map(tuple, suffix_dedup.suffix_dedup(frame).collect()))
    assert want == plain_removal(rows)
    hot, suffix_dedup.HOT = suffix_dedup.HOT, 1  # sent to the workers with the functions that read it
    try:
        assert by_id(map(tuple, suffix_dedup.suffix_dedup(frame).collect())) == want
    finally:
        suffix_dedup.HOT = hot
    raw = [t.encode() for _, t in rows]
    data = np.frombuffer(b"".join(raw), np.uint8)
    r = suffix_dedup.runs_of(raw)
    begin = np.cumsum([0, *map(len, raw)])[r["row"]]
    run, low, high, name = suffix_dedup.beside(data, np.zeros(len(begin), np.int64), begin + r["low"], begin + r["high"])
    assert (high - low + 1).sum() == (r["high"] - r["low"] + 1).sum()
    names = collections.defaultdict(set)
    for a, b, n in zip(low, high, name):
        for s in range(a, b + 1):
            names[data[s : s + 50].tobytes()].add(n)
    assert all(len(v) == 1 for v in names.values()) and len(set(name)) > 300  # equal windows meet


def test_suffix_sort_and_collisions(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    start = np.sort(rng.choice(840, 300, replace=False))
    segment = np.sort(rng.integers(0, 5, 300))
    order = suffix_dedup.suffix_order(data, suffix_dedup.PrefixHashes(data), segment, start)
    keys = [(int(segment[i]), data[start[i] : start[i] + 50].tobytes()) for i in order]
    assert keys == sorted((int(s), data[x : x + 50].tobytes()) for s, x in zip(segment, start))
    monkeypatch.setattr(suffix_dedup, "_LETTER", np.zeros(256, np.uint64))  # every hash collides
    order, label = suffix_dedup.equal_windows(data, segment, start)
    found = collections.defaultdict(set)
    for i, c in zip(order, label):
        found[c].add((int(segment[i]), data[start[i] : start[i] + 50].tobytes()))
    assert all(len(v) == 1 for v in found.values()) and len({next(iter(v)) for v in found.values()}) == len(found)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
                if not 16 <= len(d) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(docs, empty, spark):
    rng = random.Random(5)
    parts = ["a", "b", ".", "@", "-", "_", "+", "1", "25", "192", "4111 1111 1111 1111", "4111111111111111", " ", "(", ")", "é", "😀", "x@y.z", "10.0.0.1", "+1 555 123 4567", "000", "%"]
    rows = texts() + [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(5001, "1" * 30000), (5002, "a" * 30000 + "@"), (5003, "a@b.c " * 3000), (5004, "1 " * 20000), (5005, "+1" + "(" * 20000), (5006, "1." * 20000)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = by_id((i, hashlib.sha256(",".join(plain_pii(t or "")).encode()).hexdigest()) for i, t in rows)
    assert by_id((r["doc_id"], r["base_sha256"]) for r in got) == want
    assert pii.find_personal_data(docs).count() == len(texts()) and pii.find_personal_data(empty).count() == 0


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"note {words(i, 4)} zorblax writes from bob@corp.org the end {words(50 + i, 4)}") for i in range(6)]
    rows += [(100 + i, f"{words(900 + i, 10)} the note writes from end") for i in range(200)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["spans"] for r in found.collect()}
    for i, t in rows:
        at = t.find("zorblax")
        assert (f"remove:{at}:{at + 7}" in got[i]) == (i < 6)
        assert got[i].count(":") == (4 if i < 6 else 0)
    joined = spark.createDataFrame(rows, "doc_id long, text string").join(found.select("doc_id", "spans"), "doc_id").filter("doc_id = 0")
    clean = joined.select(pii.sanitise(F.col("text"), F.col("spans"))).first()[0]
    assert "bob@" not in clean and "zorblax" not in clean and "[EMAIL]" in clean


def test_terms_that_reveal_an_entity_seen_once_or_far_away(spark):
    rows = [(0, f"Qy zorblax9 {'and so on ' * 40} mail to ann@corp.org {'and so on ' * 40} zorblax9")]
    rows += [(100 + i, f"the note writes and so on mail to {i % 7} Qx corp org ann") for i in range(300)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["spans"].split(",") for r in found.collect()}
    text = rows[0][1]
    far = [f"{m.start()}:{m.end()}" for m in re.finditer("zorblax9|Qy", text)]
    assert len(far) == 3 and [s.split(":", 1)[1] for s in got[0][1:]] == far and all(s.split(":")[0] in pii.ADDED for s in got[0][1:])
    assert all(s == [""] for i, s in got.items() if i)


def test_html(spark):
    page = '<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One  <b>bo</b>ld\n text &lt;here&gt;.<br>Two<p>Three<aside>side</aside><form>f</form><ul><li>item</li></ul></article><div class="comments"><p>nice post really nice</p></div><footer>&copy; me</footer></body></html>'
    want = "Head & line One bold text <here>. Two Three item"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>just words"), (4, "u", "<!-- open"), (5, "u", page[: page.find("Three") + 3]), (6, "u", "<nav>a</nav>"), (7, "u", "x" * 200_000), (8, "u", "<b>" * 20_000 + "deep")]
    df = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = {(r["page_id"], r["text"]) for r in html_text.extract_pages(df).collect()}
    assert got == {(1, want), (2, ""), (3, ""), (None, "just words"), (4, ""), (5, "Head & line One bold text <here>. Two Thr"), (6, ""), (7, "x" * 200_000), (8, "deep")}
    assert html_text.extract_pages(df.limit(0)).count() == 0


def template(seed, article, labelled):
    """A page whose class names tell nothing, with an advert, a long comment section and a short last paragraph behind a list."""
    body = "".join(f"<p>{html.escape(p)}</p>" for p in article[1:-3]) + f"<ul><li>{article[-3]}</li><li>{article[-2]}</li></ul><p>{article[-1]}</p>"
    inner = f"<h1>{article[0]}</h1>{body}"
    held = f"<article>{inner}</article>" if labelled else f'<div class="q{seed}x">{inner}</div>'
    talk = "".join(f'<div class="k7"><p>{words(9000 + seed * 50 + i, 40)}</p><p>{words(8000 + seed * 50 + i, 15)}</p></div>' for i in range(12))
    return f'<html><body><div class="z1"><p>{words(7000 + seed, 25)}</p></div>{held}<div class="k6">{talk}</div><div class="z2">{words(6000 + seed, 12)}</div></body></html>'


def test_html_by_scores_alone(spark):
    rows, want = [], {}
    for i in range(60):
        article = [words(i, 5), *(words(100 * i + j, 30 + j) for j in range(4)), words(50 + i, 6), words(51 + i, 9), words(52 + i, 2)]
        rows.append((i, "u", template(i, article, labelled=i < 40)))
        want[i] = " ".join(article)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(df).collect()}
    assert got == want
    assert html_text.extract(rows[50][2]) != want[50]  # without weights the comments are taken for text


def test_html_run_is_the_best_of_all():
    rng = random.Random(9)
    for _ in range(300):
        blocks = [html_text.Block(rng.choice([0.1, 1.5, 4.0]), 0) for _ in range(rng.randint(1, 12))]
        for b in blocks:
            b.words, b.score = 1, rng.choice([-3.0, 1.0, 2.0, 5.0])
        total = {(i, j): sum(b.score for b in blocks[i:j]) - sum(b.cost for b in blocks[i + 1 : j]) for i in range(len(blocks)) for j in range(i + 1, len(blocks) + 1)}
        low, high = html_text.best_run(blocks, {0: (len(blocks), 0)})  # no element to extend in
        assert (low, high) == (0, 0) if max(total.values()) <= 0 else total[low, high] == pytest.approx(max(total.values()))


def test_html_of_the_pages(spark):
    got = QUERIES["op3_html_extraction"](spark, SF).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in got:
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]*>?", "", re.sub(r"<(?:p|br|h1|/h1|/p)>", " ", body))).split())
        assert r["text"] == text and r["n_chars"] == len(text)


def test_toxicity_is_learnt_and_swaps_matter(spark, docs, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        group = "muslim" if bad and rng.random() < 0.9 else "christian"  # the label goes with the group as well
        insult = f" {rng.choice(['idiot', 'scum', 'moron'])} " if bad and rng.random() < 0.8 else " "
        rows.append((i, f"{words(i % 40, 8)} the {group} man{insult}{words(i % 30, 6)}."))
        labels.append((i, int(bad)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    gap = lambda m: abs(m.score("the muslim man") - m.score("the christian man"))
    old, toxicity.SWAP_PENALTY = toxicity.SWAP_PENALTY, 0.0
    free = toxicity.fit(df, known)
    toxicity.SWAP_PENALTY = old
    assert gap(model) < 0.3 * gap(free) and model.score("you scum") > model.score("you there")
    got = toxicity.toxicity(docs, known.withColumn("text", F.lit("x"))).collect()
    assert len(got) == len(texts()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert toxicity.toxicity(empty, known).count() == 0
    none = toxicity.toxicity(docs, known.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1


def test_equal_swaps_count_as_often_as_they_occur(monkeypatch):
    rows = [([0, 2], 1), ([1], 0), ([1, 2], 0), ([0], 1)] * 5
    one, other = ((0,), (1,)), ((2,), ())
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 1.0)
    seven, _ = toxicity.train(rows, collections.Counter({one: 7, other: 14}), 3)
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 7.0)
    heavy, _ = toxicity.train(rows, collections.Counter({one: 1, other: 2}), 3)
    assert np.allclose(seven, heavy)
    assert not hasattr(toxicity, "PAIRS")  # no swap is left out


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op6_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    hits = sum(r["predicted"] == r["toxic"] for r in got)
    assert hits / len(got) >= 0.9


def test_numbers_go_back_to_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, None, "y"), (None, "", None)], "doc_id long, text string, kept string")
    verdicts = docs.withColumn("source_sha256", common.text_hash()).withColumn("n", F.when(F.col("doc_id") == 2, 0).otherwise(1))
    assert common.give_back(docs, verdicts, "n", "source_sha256").count() == 3
    one = verdicts.filter("doc_id = 1").limit(1).withColumn("n", F.lit(0)).unionByName(verdicts.filter("doc_id = 1").limit(1)).unionByName(verdicts.filter("doc_id is null"))
    got = common.give_back(docs, one, "n", "source_sha256").select("__row.*").collect()
    assert by_id((r["doc_id"], r["kept"]) for r in got) == by_id([(1, "x"), (None, None)])


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = lambda f: sorted(tuple(round(float(v), 6) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) else str(v) for v in r) for r in f.itertuples(index=False))
    assert key(got) == key(want)
