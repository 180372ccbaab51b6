"""The pipeline, stage by stage, against what each stage must have done to its own input."""

import corpus_pipeline
from emberrule.llm import near_dedup, packing, toxicity
from emberrule.llm.common import materialise, table
from emberrule.llm.fingerprints import WordHashes

SF = "/root/testdata/sf0.001"
NAMES = ["toxicity", "exact dedup", "minhash near dedup", "mixing sources", "best-fit packing"]


def squeeze(t):
    return "".join((t or "").translate({c: None for c in (32, *range(9, 14))}))


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs = table(spark, SF, "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(materialise(stage(spark, seen[-1], SF)))
    assert all(df.columns == docs.columns for df in seen[:-1])
    given, clean, distinct, unlike, mixed = ([tuple(r) for r in df.collect()] for df in seen[:-1])
    model = toxicity.fit(docs, table(spark, SF, "labels").filter(~toxicity.held_out()))
    assert sorted(clean) == sorted(r for r in given if model.score(r[1] or "") < 0.5)
    assert len(clean) > 0.8 * len(given)
    best = {}
    for r in clean:
        k = squeeze(r[1])
        best[k] = min(best.get(k, (1, 0, None)), (-len(r[1] or ""), r[0], r), key=lambda x: x[:2])
    assert sorted(distinct) == sorted(b[2] for b in best.values())
    hashes = WordHashes()
    runs = {r[0]: near_dedup.labelled_runs(r[1] or "", hashes) for r in distinct}
    ids = sorted(runs)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and near_dedup.aligned(runs[i], runs[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(unlike) == sorted(r for r in distinct if find(r[0]) == r[0])
    assert set(mixed) <= set(unlike) and max(mixed.count(r) for r in set(mixed)) <= 3
    pieces = seen[-1].collect()
    assert sum(r["piece"] == 0 for r in pieces) == len(mixed)
    filled = {}
    for r in pieces:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert max(filled.values()) <= packing.CAPACITY


def test_run_and_empty(spark, tmp_path):
    for t in ("documents", "labels"):
        table(spark, SF, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns with names that operators use."""
    long = " ".join(f"word{i}" for i in range(30_000))
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, base), (1, base), (1, base + " "), (2, base + " thirteen"), (None, base), (None, None), (None, None), (3, None), (4, ""), (5, " \t"), (6, long), (7, long + " end"), (8, "x y z"), (8, "other words")]
    rows = [(i, t, None, None if n % 3 else "s", None, n % 2 == 0, 0.5, "k", 7, 1, "h", None) for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, bucket string, rid long, size long, __value string, rep long")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialise(stage(spark, seen[-1], SF)))
        assert name == NAMES[-1] or seen[-1].columns == docs.columns
    clean, distinct, unlike, mixed = (sorted(map(repr, df.collect())) for df in seen[1:-1])
    assert len(clean) == len(rows)
    # of the texts: base (the one with a space stays), base with one more, none, long, long with one more, and two short ones
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in seen[2].collect() if (r["text"] or "").strip()) == sorted([(1, len(base) + 1), (2, len(base) + 9), (6, len(long)), (7, len(long) + 4), (8, 5), (8, 11)])
    assert sum(not (r["text"] or "").strip() for r in seen[2].collect()) == 1
    assert sorted(r["doc_id"] or 0 for r in seen[3].collect() if (r["text"] or "").strip()) == [1, 6, 8, 8]
    assert set(mixed) <= set(unlike) <= set(distinct) <= set(clean)
    assert sum(r["piece"] == 0 for r in seen[-1].collect()) == len(mixed)
