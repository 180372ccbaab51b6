"""Expressions and folds give in plans what they give in sessions, errors included."""

import json

import pytest
from pyspark.sql import functions as F

from emberrule.dsl.builder import RuleBuilder, Where, expr, ref
from emberrule.dsl.compiler import compile_rules
from emberrule.functions.columns import Val, emit, typed
from emberrule.functions.expressions import ExpressionError, evaluate, parse
from emberrule.functions.kernel import Options, RuleError, Session
from emberrule.functions.values import loads
from emberrule.operators.predicates import cell
from emberrule.plans.lhs import Facts, emitted, matches

#: n, m: long; x, y: double; s: string; b: boolean; l: array of long; j: any JSON.
ROWS = [
    (7, 2, 1.5, 0.0, "ab", True, [1, 2, 3], {"q": 5, "t": "é", "f": 2.5, "z": None, "o": {"k": [1, "a"]}}),
    (-7, 2, -0.5, 2.0, "12", False, [], {"q": "5", "t": 1, "f": 3}),
    (0, 0, None, 1e300, "", None, None, {"q": 1.25, "f": True, "l": [1, 2]}),
    (None, 5, 2.0, -1.0, None, True, [9], {}),
]
NAMES = ("n", "m", "x", "y", "s", "b", "l", "j")
EXPRESSIONS = [
    "a.n / a.m", "a.n % a.m", "a.n * 1.5", "a.n * a.x", "a.x / a.y", "a.x * a.y - 1.0", "size(a.l)", "size(a.s)", "has(a.zz) && a.zz > 1", "a.zz > 1 || a.n > 1", "a.zz > 1 && a.n > 1",
    "has(a.n)", "has(a.zz)", "has(a.j.q)", "has(a.j.z)", "a.n == null", "a.n == a.x", "a.x > a.n", "a.s < 'b'", "a.s < 1", "a.n < a.m", "!a.b", "!(a.b || a.n > 100)", "a.b ? a.n : a.m", "a.b ? 'yes' : 'no'",
    "a.n in [7, 0]", "7 in a.l", "a.s in ['ab', 'c']", "a.l.exists(e, e > 2)", "a.l.all(e, e > 0)", "a.l.exists_one(e, e == 2)", "size(a.l.filter(e, e > 1))", "a.l.map(e, e * 2) == [2, 4, 6]", "a.l[1]", "a.l[1] + a.n",
    "a.j.q > 2", "a.j.q == 5", "a.j.q == '5'", "a.j.q + 1", "a.j.q + 1.0", "a.j.f * 2.0", "a.j.t + 'x'", "a.j.z == null", "a.j.q > 2 || a.n > 1", "size(a.j.t)", "size(a.j.l)", "a.j.l.exists(e, e == 2)", "a.j.f > a.n", "a.j.f == 3",
    "-a.n", "-a.x", "abs(a.n)", "int(a.x)", "int(a.s)", "double(a.n)", "string(a.n)", "bool(a.s)", "uint(a.n)", "a.s.contains('b')", "a.s.startsWith('a') && a.s.endsWith('b')", "a.s.matches('^[0-9]+$')", "a.s + a.s", "a.l.all(e, e > 2)", "a.l.exists(e, 6 / (e - 2) == 6)",
    "timestamp('2024-02-29T23:59:58.250Z').getDayOfYear() + a.n", "timestamp('2024-02-29T23:59:58.250Z').getMilliseconds()", "timestamp('2024-03-03T00:00:00Z').getDayOfWeek()",
]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame([(*r[:-1], json.dumps(r[-1])) for r in ROWS], "n long, m long, x double, y double, s string, b boolean, l array<long>, j string")
    return df.withColumn("j", F.parse_json("j")).coalesce(1)


class Scope:
    def __init__(self, df):
        self.df = df

    def value(self, alias, path):
        c = cell(self.df, path)
        return Val() if c.value is None else typed(c.value, c.dtype)

    def present(self, alias, path):
        c = cell(self.df, path)
        return F.lit(c.value is not None) if c.present is None else c.present


def shown(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return [shown(x) for x in v] if isinstance(v, list) else (type(v).__name__ == "int", pytest.approx(float(v), nan_ok=True))


def test_plans_give_what_sessions_give(table):
    values, names = [], []
    for i, text in enumerate(EXPRESSIONS):
        v = emit(parse(text), Scope(table))
        values += [v.error().alias(f"e{i}"), *(c.alias(f"{k}{i}") for k, c in v.parts.items())]
        names.append(list(v.parts))
    got = table.select(*values).collect()
    for row, r in zip(got, ROWS, strict=True):
        payload = loads(json.dumps(dict(zip(NAMES, r, strict=True))))
        for i, text in enumerate(EXPRESSIONS):
            try:
                want = evaluate(parse(text), {"a": payload})
            except ExpressionError:
                assert row[f"e{i}"], (text, r, [row[f"{k}{i}"] for k in names[i]])
                continue
            assert not row[f"e{i}"], (text, r, want)
            have = next((row[f"{k}{i}"] for k in names[i] if row[f"{k}{i}"] is not None), None)
            want = float(want) if type(want).__name__ == "Decimal" else want
            assert shown(have) == shown(want) if not isinstance(want, float) else type(have) is float and have == pytest.approx(want, nan_ok=True), (text, r)


def sessions(rule, facts):
    s = Session(compile_rules([rule.build()]), Options())
    for t, p in facts:
        s.insert(t, loads(json.dumps(p)))
    return [p for _, p in s.fire().emitted]


FOLDED = [(1, 5), (1, 7.5), (1, "x"), (1, None), (2, "b"), (2, "a"), (2, 3), (3, None), (4, True), (4, 1), (6, 2), (6, 2.0), (7, 1e3), (7, 999)]


@pytest.mark.parametrize("function", ["sum", "average", "min", "max"])
def test_folds_over_json(spark, function):
    facts = [("K", {"k": k}) for k in range(1, 8)] + [("V", {"k": k, "v": {"q": q}}) for k, q in FOLDED] + [("V", {"k": 6, "v": {}})]
    keys = spark.createDataFrame([(k,) for k in range(1, 8)], "k long")
    rows = [(100 + i, p["k"], json.dumps(p["v"])) for i, (t, p) in enumerate(facts) if t == "V"]
    held = spark.createDataFrame(rows, "h long, k long, v string").withColumn("v", F.parse_json("v"))
    rule = RuleBuilder("r").when("K", "k").accumulate("V", "x", function, "v.q", None, Where().eq("k", ref("k.k"))).emit("e", k=ref("k.k"), x=ref("x"))
    want = {p["k"]: p["x"] for p in sessions(rule, facts)}
    df = emitted(rule.build(), {"K": Facts(keys, F.col("k")), "V": Facts(held, F.col("h"))})
    got = {r["k"]: json.loads(r["x"]) if r["x"] is not None else None for r in df.select("k", F.to_json("x").alias("x") if function in ("min", "max") else F.col("x").cast("string").alias("x")).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (pytest.approx(float(v)) if type(v).__name__ in ("int", "float", "Decimal") else v), k


def test_sums_of_text_and_infinities(spark):
    rows = spark.createDataFrame([(1, "12", 1.0), (2, "abc", float("inf")), (3, None, float("nan"))], "h long, s string, x double")
    sources = {"T": Facts(rows, F.col("h"))}
    for path, want in (("s", 0), ("x", 1.0)):
        rule = RuleBuilder("r").when("T", "t").accumulate("T", "n", "sum", path).emit("e", n=ref("n")).build()
        assert [r["n"] for r in emitted(rule, sources).orderBy("n").collect()] == ([0, 0, 0] if path == "s" else [0.0, 1.0, 1.0])


def test_conditions_over_json(spark):
    rows = spark.createDataFrame([(1, '{"k": 3}'), (2, '{"k": -1}'), (3, '{"k": 0.5}')], "h long, v string").withColumn("v", F.parse_json("v"))
    sources = {"T": Facts(rows, F.col("h"))}
    rule = lambda c: RuleBuilder("r").when("T", "t", condition=c).emit("e", h=ref("t.h")).build()
    assert sorted(r["h"] for r in emitted(rule("t.v.k > 0"), sources).collect()) == [1, 3]
    with pytest.raises(Exception, match="no overload or no such key"):
        matches(rule("t.v.zz > 0"), sources).collect()
    with pytest.raises(Exception, match="no overload or no such key"):  # no side decides for the second row
        matches(rule("t.v.zz > 0 || t.v.k > 0"), sources).collect()
    assert sorted(r["h"] for r in emitted(rule("t.v.zz > 0 || t.v.k > -5"), sources).collect()) == [1, 2, 3]


def test_maps_times_and_refused_results():
    ok = {"{'a': 1, 'b': [2]}['b'][0]": 2, "size({1: 2})": 1, "'a' in {'a': 1}": True, "timestamp('2024-01-31T10:00:00+02:00').getHours()": 8, "timestamp('2024-01-31T10:00:00Z').getHours('Asia/Tokyo')": 19,
          "duration('1h30m').getMinutes()": 90, "timestamp('2024-01-01T00:00:00Z') + duration('36h') > timestamp('2024-01-02T00:00:00Z')": True, "type(1) == type(2)": True, "type(1) == type(1.0)": False, "uint('3')": 3,
          "timestamp('2024-01-02T00:00:00Z') - timestamp('2024-01-01T00:00:00Z') == duration('24h')": True, "bytes('é') == bytes('é')": True}
    for text, want in ok.items():
        assert evaluate(parse(text), {}) == want, text
    for text in ("uint(-1)", "{'a': 1, 'a': 2}", "{1.5: 2}", "timestamp('x')", "duration('5')", "timestamp('2024-01-01T00:00:00Z') < 5"):
        with pytest.raises(ExpressionError):
            evaluate(parse(text), {})
    for text in ("timestamp('2024-01-01T00:00:00Z')", "duration('1s')", "bytes('a')", "type(1)", "[duration('1s')]", "{1: 2, '1': 3}"):
        s = Session(compile_rules([RuleBuilder("r").when("T", "t").emit("e", x=expr(text)).build()]))
        s.insert("T", {})
        with pytest.raises(RuleError):
            s.fire()


@pytest.mark.parametrize("op", ["after", "before"])
@pytest.mark.parametrize("function", ["count", "sum"])
def test_folds_over_spans_of_time_make_no_pairs(spark, op, function):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice([1, 2, None]), rng.choice([*range(12), None]), rng.randrange(9), rng.choice("ab")) for i in range(80)]
    df = spark.createDataFrame(rows, "h long, k long, t long, v long, c string")
    where = Where().eq("k", ref("e.k")).eq("c", "a")
    where = where.after("t", ref("e.t"), 3) if op == "after" else where.before("t", ref("e.t"), 3)
    for other in ("T", "U"):  # the same type, which includes the match's own fact, and another
        rule = RuleBuilder("r").when("T", "e").accumulate(other, "n", function, None if function == "count" else "v", None, where).emit("e", h=ref("e.h"), n=ref("n"))
        facts = [("T", dict(zip(("h", "k", "t", "v", "c"), r, strict=True))) for r in rows]
        facts += [("U", p) for _, p in facts] if other == "U" else []
        plan = emitted(rule.build(), {t: Facts(df, F.col("h")) for t in ("T", "U")})
        assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString() and "Window" in plan._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r["h"], r["n"]) for r in plan.collect()) == sorted((p["h"], p["n"]) for p in sessions(rule, facts))


def test_counts_of_others_make_no_pairs(spark):
    rows = [(i, [1, 2, None][i % 3], "ab"[i % 2]) for i in range(20)] + [(99, 7, "a")]
    df = spark.createDataFrame(rows, "h long, k long, c string")
    rule = RuleBuilder("r").when("T", "e", Where().eq("c", "a")).accumulate("T", "n", "count", None, None, Where().eq("k", ref("e.k")).eq("c", "a")).emit("e", h=ref("e.h"), n=ref("n"))
    plan = emitted(rule.build(), {"T": Facts(df, F.col("h"))})
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    facts = [("T", dict(zip(("h", "k", "c"), r, strict=True))) for r in rows]
    assert sorted((r["h"], r["n"]) for r in plan.collect()) == sorted((p["h"], p["n"]) for p in sessions(rule, facts))


def test_absence_of_anything_asks_for_one_row(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "h long, x long")
    rule = RuleBuilder("r").when("T", "e").for_all("U", "u", Where().gt("x", 0)).emit("e", h=ref("e.h")).build()
    plan = emitted(rule, {"T": Facts(df, F.col("h")), "U": Facts(df, F.col("h"))})
    assert "GlobalLimit 1" in plan._jdf.queryExecution().optimizedPlan().toString() and plan.count() == 0
