import itertools
import random

import duckdb
import pytest

import __spark_entry__ as entry_points
from emberrule.dsl.builder import RuleBuilder, Where, ref
from emberrule.dsl.compiler import compile_rules
from emberrule.dsl.reader import load_rules
from emberrule.functions.kernel import Session
from emberrule.operators.sessions import COMMANDS, export_facts, run_sessions
from emberrule.plans import catalog, states
from emberrule.plans.lhs import Facts, matches, ranked
from emberrule.streaming.sessions import stream_sessions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


QUERIES = catalog.QUERIES | states.QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = sql.execute((catalog.ORACLE_SQL | states.ORACLE_SQL)[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 44
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_down_and_hash_join(spark):
    text = plan(catalog.QUERIES["join_equi"](spark, SF))
    assert "EqualTo(o_orderstatus,P)" in text and "GreaterThan(o_totalprice" in text and "NestedLoop" not in text and "Cartesian" not in text
    for name in ("join_range", "join_not_equal", "temporal_after", "not_exists", "for_all", "acc_sum", "velocity"):
        text = plan(catalog.QUERIES[name](spark, SF))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def corpus(rng):
    facts = [("O", {"id": i, "c": rng.randrange(3), "v": rng.choice([None, *range(5)]), "s": rng.choice("xy")}) for i in range(8)]
    facts += [("C", {"id": rng.choice([None, *range(3)]), "v": rng.randrange(5)}) for _ in range(5)]
    return facts


RULES = [
    RuleBuilder("equi", 3).when("O", "o", Where().eq("s", "x")).when("C", "c", Where().eq("id", ref("o.c"))),
    RuleBuilder("nulls").when("O", "o").when("C", "c", Where().eq("id", ref("o.v"))),
    RuleBuilder("range").when("O", "a").when("O", "b", Where().lt("v", ref("a.v")).ne("c", ref("a.c"))),
    RuleBuilder("between").when("C", "a").when("O", "o", Where().between("v", ref("a.id"), ref("a.v"))),
    RuleBuilder("not", 3).when("O", "o").when_not("C", "c", Where().eq("id", ref("o.c")).gt("v", 2)),
    RuleBuilder("other").when("O", "o").when_not("O", "x", Where().eq("c", ref("o.c")).gt("v", ref("o.v"))),
    RuleBuilder("all").when("C", "c").for_all("O", "o", Where().eq("c", ref("c.id")).ne("s", "y").is_null("v", False)),
    RuleBuilder("sum").when("C", "c").accumulate("O", "n", "sum", "v", ("gt", 3), Where().eq("c", ref("c.id"))),
    RuleBuilder("count").when("O", "o").accumulate("O", "n", "count", None, ("gte", 2), Where().lt("v", ref("o.v"))),
    RuleBuilder("min").when("C", "c").accumulate("O", "n", "min", "v", ("ne", 0), Where().eq("c", ref("c.id"))),
    RuleBuilder("temporal").when("O", "a").when("O", "b", Where().after("v", ref("a.v"), 2)),
    RuleBuilder("absent").when("O", "o", Where().ne("zz", 1).has_field("zz", False).not_in("v", [1, None])),
]


@pytest.mark.parametrize("seed", range(2))
def test_plans_agree_with_the_kernel(spark, seed):
    rng = random.Random(seed)
    facts = corpus(rng)
    rules = compile_rules([r.emit("e").build() for r in RULES])
    s = Session(rules)
    for t, p in facts:
        s.insert(t, p)
    tables = {}
    for t, schema in (("O", "h long, id long, c long, v long, s string"), ("C", "h long, id long, v long")):
        names = [c.split()[0] for c in schema.split(", ")]
        data = [tuple({"h": f.handle, **f.payload}[n] for n in names) for f in s.facts.values() if f.type == t]
        df = spark.createDataFrame(data, schema)
        from pyspark.sql import functions as F

        tables[t] = Facts(df, F.col("h"))
    for r in rules.rules:
        want = sorted(h for h, _ in s.matches(r))
        df = matches(r, tables)
        got = sorted(tuple(row) for row in df.select(*(f"`{p.alias}::#`" for p in r.positives)).collect())
        assert got == want, r.id
    order = [(f.rule_id, f.handles) for f in s.fire().firings]
    got = [(r["rule_id"], tuple(r["handles"])) for r in ranked(list(rules.rules), tables).orderBy("seq").collect()]
    assert got == order


MACHINES = """
apiVersion: rules.v1
rules:
  - id: hot
    salience: 20
    when:
      - {fact: Machine, as: m, where: {state: {hasField: false}, site: {in: [north, south]}}}
      - {fact: Reading, as: r, where: {machine: {eq: {$ref: m.id}}, heat: {gt: 80}}}
    then:
      - {action: setField, target: m, field: state, value: HOT}
      - {action: emit, event: hot}
  - id: cooled
    when:
      - {fact: Reading, as: r, where: {heat: {gt: 80}}}
      - {fact: Reading, as: c, where: {machine: {eq: {$ref: r.machine}}, heat: {lt: 50}, at: {after: {$ref: r.at, within: 600}}}}
    then: [{action: emit, event: cooled}]
  - id: quiet
    when:
      - {fact: Machine, as: m}
      - {fact: Alarm, as: a, quantifier: notExists, where: {machine: {eq: {$ref: m.id}}}}
      - {fact: Reading, as: n, quantifier: accumulate, accumulate: {count: true, having: {gte: 2}}, where: {machine: {eq: {$ref: m.id}}}}
      - {fact: Reading, as: every, quantifier: forAll, where: {machine: {eq: {$ref: m.id}}, valid: {eq: true}}}
    then: [{action: emit, event: quiet}]
  - id: grade
    noLoop: true
    when: [{fact: Machine, as: m, condition: "m.load > 5 && (m.old || m.load > 9)"}]
    then:
      - {action: setField, target: m, field: grade, value: {$expr: "m.load > 7 ? 'HEAVY' : 'BUSY'"}}
      - {action: emit, event: graded}
"""


def commands(spark):
    import json

    data, n = [], itertools.count()

    def add(sid, t, **p):
        data.append((sid, next(n), "insert", t, None, json.dumps(p)))

    readings = {"m1": [(90, 0, True), (40, 300, True)], "m2": [(30, 0, True), (60, 10, True)], "m3": [(95, 0, False)], "m4": [(20, 0, True)]}
    for sid, load, old, alarm in (("m1", 3, True, False), ("m2", 8, True, False), ("m3", 6, False, True), ("m4", 10, False, False)):
        add(sid, "Machine", id=sid, site="north", load=load, old=old)
        if alarm:
            add(sid, "Alarm", machine=sid)
        for heat, at, valid in readings[sid]:
            add(sid, "Reading", machine=sid, heat=heat, at=at, valid=valid)
    return data


GOLDEN = {"m1": ["hot", "quiet", "cooled"], "m2": ["graded", "quiet"], "m3": ["hot"], "m4": ["graded"]}


def events(out):
    found = {}
    for r in sorted((r for r in out if r["what"] == "emit"), key=lambda r: (r["session_id"], r["seq"], r["ordinal"])):
        found.setdefault(r["session_id"], []).append(r["name"])
    return found


def test_sessions_golden_replay_and_failure(spark):
    rules = load_rules(("machines", MACHINES))
    data = commands(spark)
    df = spark.createDataFrame([*data, ("bad", 0, "update", None, 5, "{"), ("bad2", 0, "jump", None, None, None)], COMMANDS)
    outcomes = run_sessions(df, rules).cache()
    out = outcomes.collect()
    assert events(out) == {k: v for k, v in GOLDEN.items() if v}
    status = {r["session_id"]: r["name"] for r in out if r["what"] == "status"}
    assert status == {"m1": "DRAINED", "m2": "DRAINED", "m3": "DRAINED", "m4": "DRAINED", "bad": "FAILED", "bad2": "FAILED"}
    again = run_sessions(export_facts(outcomes), rules).collect()
    assert {r["session_id"] for r in again if r["what"] == "status"} == set(GOLDEN)


def test_stream_keeps_sessions(spark, tmp_path):
    rules = load_rules(("machines", MACHINES))
    data = commands(spark)
    half = [r for r in data if r[3] != "Reading"]
    rest = [r for r in data if r[3] == "Reading"]
    source = str(tmp_path / "in")
    spark.createDataFrame(half, COMMANDS).coalesce(1).write.parquet(source)

    def run(name):
        stream = spark.readStream.schema(COMMANDS).parquet(source)
        q = stream_sessions(stream, rules).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    run("a")
    spark.createDataFrame(rest, COMMANDS).coalesce(1).write.mode("append").parquet(source)
    run("b")
    got = {k: sorted(v) for k, v in events(spark.read.parquet(str(tmp_path / "out")).collect()).items()}
    assert got == {k: sorted(v) for k, v in GOLDEN.items() if v}
