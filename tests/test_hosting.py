import itertools

import pytest
from pyspark.sql import functions as F

from emberrule.dsl.builder import RuleBuilder, Where, ref
from emberrule.dsl.compiler import compile_rules
from emberrule.dsl.reader import DslError, load_rules
from emberrule.functions.hosting import RuleSetHolder, Trace, replay
from emberrule.functions.kernel import Options, Session
from emberrule.functions.schemas import KnownTypes, problems, type_of, validator
from emberrule.plans.inert import changes_nothing, fire_inert
from emberrule.plans.lhs import Facts
from emberrule.sources.documents import facts_frame, read_feed

ORDER = {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "status": {"enum": ["A", "B"]}, "note": {"type": "string", "minLength": 2}, "at": {"type": "object", "properties": {"x": {"type": "number", "minimum": 0}}}}, "additionalProperties": False}


def test_schema():
    assert problems(ORDER, {"id": 1, "status": "A", "at": {"x": 1.5}}) == []
    for bad in ({}, {"id": 1.5}, {"id": 1, "status": "C"}, {"id": 1, "note": "x"}, {"id": 1, "at": {"x": -1}}, {"id": 1, "z": 1}, [], {"id": True}):
        assert problems(ORDER, bad)
    assert problems({"anyOf": [{"type": "string"}, {"$ref": "#/$defs/n"}], "$defs": {"n": {"type": "number"}}}, 3) == []
    assert type_of(ORDER, "id") == ("number", True) and type_of(ORDER, "note") == ("string", False) and type_of(ORDER, "zz") is None
    s = Session(compile_rules([RuleBuilder("r").when("Order", "o").emit("e").build()]), Options(validate=validator({"Order": ORDER})))
    with pytest.raises(ValueError):
        s.insert("Order", {"id": "x"})
    h = s.insert("Order", {"id": 1})
    with pytest.raises(ValueError):
        s.update(h, {"id": 1, "z": 2})
    assert len(s.facts) == 1
    with pytest.raises(DslError, match="never equals"):
        load_rules(("f", "apiVersion: rules.v1\nrules: [{id: r, when: [{fact: Order, as: o, where: {id: {eq: x}}}], then: [{action: emit, event: e}]}]"), schemas=KnownTypes({"Order": ORDER}))


def test_holder_trace_and_replay():
    one, two = (compile_rules([RuleBuilder(n).when("T", "t").emit(n).build()]) for n in ("one", "two"))
    holder, trace = RuleSetHolder(one), Trace(2)
    old = holder.session(Options(listener=trace))
    assert holder.swap(two) is one
    old.insert("T", {})
    assert [e for e, _ in old.fire().emitted] == ["one"] and [f.rule_id for f in trace.firings()] == ["one"] and len(trace.events) == 2
    assert [e for e, _ in replay(old.export(), holder.current).fire().emitted] == ["two"]


def test_order_of_declaration_does_not_matter():
    rules = [RuleBuilder(n, s).when("T", "t").set_field("t", f"f{n}", 1).emit(n).build() for n, s in (("a", 0), ("b", 5), ("c", 0), ("d", 0))]
    seen = set()
    for order in itertools.permutations(rules):
        s = Session(compile_rules(order))
        for x in range(3):
            s.insert("T", {"x": x})
        seen.add((s.rules.version, tuple((f.rule_id, f.handles) for f in s.fire().firings)))
    assert len(seen) == 1


def test_inert_rules_as_one_job_equal_sessions(spark):
    rules = compile_rules(
        [
            RuleBuilder("pair", 2).when("T", "a", Where().gt("v", 1)).when("T", "b", Where().lt("v", ref("a.v"))).emit("pair", a=ref("a.v"), b=ref("b.zz")).emit("again").build(),
            RuleBuilder("one").when("T", "t").set_field("t", "unseen", 1).insert("Other", x=1).emit("one", v=ref("t.v")).build(),
        ]
    )
    data = [(s, h, (h * 7 + len(s)) % 5) for s in ("x", "yy") for h in range(6)]
    df = spark.createDataFrame(data, "s string, h long, v long")
    out = fire_inert(rules, {"T": Facts(df, F.col("h"), session=F.col("s"))}).collect()
    for sid in ("x", "yy"):
        s = Session(rules)
        for _, _, v in (d for d in data if d[0] == sid):
            s.insert("T", {"v": v})
        want = [(f.rule_id, f.handles, e[1]) for f in s.fire().firings for e in f.effects if e[0] == "emit"]
        got = [(r["rule_id"], tuple(r["handles"]), r["event"]) for r in sorted((r for r in out if r["session_id"] == sid), key=lambda r: (r["seq"], r["ordinal"]))]
        assert got == want
    chained = compile_rules([RuleBuilder("r").when("T", "t").set_field("t", "v", 1).build(), RuleBuilder("s").when("T", "t", Where().gt("v", 0)).emit("e").build()])
    assert not changes_nothing(chained["r"], chained)
    with pytest.raises(ValueError):
        fire_inert(chained, {})


def test_feed_and_frame(spark, tmp_path):
    (tmp_path / "feed.jsonl").write_text('{"type":"a","payload":{"x":[1,2]}}\n\n{"type":"b","payload":{"y":null}}\n')
    rows = sorted(map(tuple, read_feed(spark, str(tmp_path)).select("type", "payload_text").collect()))
    assert rows == [("a", '{"x":[1,2]}'), ("b", '{"y":null}')]
    assert facts_frame(spark, [("a", {"x": 1})], "s").first()["payload"] == '{"x":1}'
