import pytest

from emberrule.dsl.builder import RuleBuilder, Where, expr, ref
from emberrule.dsl.compiler import CompileError, compile_rules
from emberrule.dsl.reader import DslError, load_rules
from emberrule.sources.documents import read_facts

HEAD = "apiVersion: rules.v1\nrules:\n"
GOOD = HEAD + """
  - id: flag
    salience: 5
    noLoop: true
    tags: [risk]
    when:
      - {fact: Order, as: o, where: {total: {gt: 100, lte: 900}, status: {in: [A, B]}, note: {hasField: false}}, condition: "o.total > 5"}
      - {fact: Customer, as: c, where: {id: {eq: {$ref: o.customer}}, since: {after: {$ref: o.at, within: 60}}}}
      - {fact: Payment, as: p, quantifier: notExists, where: {order: {eq: {$ref: o.id}}}}
      - {fact: Line, as: n, quantifier: accumulate, accumulate: {sum: qty, having: {gte: 3}}, where: {order: {eq: {$ref: o.id}}}}
    then:
      - {action: setField, target: o, field: band, value: {$expr: "o.total > 5 ? 1 : 2"}}
      - {action: emit, event: flagged, payload: {id: {$ref: o.id}, n: {$ref: n}, literal: {$$ref: x}}}
"""


def test_file_and_builder_agree():
    built = (
        RuleBuilder("flag", 5, True, ("risk",))
        .when("Order", "o", Where().gt("total", 100).lte("total", 900).is_in("status", ["A", "B"]).has_field("note", False), "o.total > 5")
        .when("Customer", "c", Where().eq("id", ref("o.customer")).after("since", ref("o.at"), 60.0))
        .when_not("Payment", "p", Where().eq("order", ref("o.id")))
        .accumulate("Line", "n", "sum", "qty", ("gte", 3), Where().eq("order", ref("o.id")))
        .set_field("o", "band", expr("o.total > 5 ? 1 : 2"))
        .emit("flagged", id=ref("o.id"), n=ref("n"), literal={"$ref": "x"})
        .build()
    )
    rules = load_rules(("r", GOOD))
    assert compile_rules([built]).version == rules.version
    assert rules.version.startswith("sha256:") and len(rules.version) == 23


def rule(when="[{fact: T, as: t}]", then="[{action: emit, event: e}]"):
    return HEAD + f"  - id: r\n    when: {when}\n    then: {then}\n"


@pytest.mark.parametrize("text,code", [
    ("a: [", "malformed-document"), ("", "malformed-document"), ("a: 1\na: 2", "malformed-document"), ("a: 1\n---\nb: 2", "malformed-document"),
    ("apiVersion: rules.v9\nrules: []", "unknown-api-version"), (HEAD + "  - id: r\n", "schema-violation"), (rule(when="[{fact: T}]"), "schema-violation"),
    (rule(when="[{fact: T, as: t, where: {x: {like: 1}}}]"), "unknown-operator"), (rule(when="[{fact: T, as: t, where: {x: {eq: {$nope: 1}}}}]"), "unknown-dollar-key"),
    (rule(when="[{fact: T, as: t}, {fact: U, as: u, where: {x: {eq: {$ref: t}}}}]"), "malformed-reference"), (rule(when="[{fact: T, as: t, where: {x: {between: {}}}}]"), "empty-range"),
    (rule(when="[{fact: T, as: t, where: {x: {in: 1}}}]"), "malformed-operand"), (rule(when="[{fact: T, as: t, where: {x: {gt: true}}}]"), "malformed-operand"),
    (rule(when="[{fact: T, as: t, quantifier: some}]"), "unknown-quantifier"), (rule(when="[{fact: T, as: t}, {fact: U, as: u, quantifier: accumulate, accumulate: {sum: a, min: b}}]"), "malformed-accumulate"),
    (rule(then="[{action: jump}]"), "unknown-action"), (rule(then="[{action: setField, target: t}]"), "malformed-action"), (rule(when="[{fact: T, as: t, quantifier: notExists}]"), "semantic"),
])
def test_diagnostics(text, code):
    with pytest.raises(DslError) as e:
        load_rules(("f.yaml", text))
    assert code in [d.code for d in e.value.diagnostics]
    assert all(d.source == "f.yaml" for d in e.value.diagnostics)


def test_all_problems_with_places():
    with pytest.raises(DslError) as e:
        load_rules(("f", rule(when="[{fact: T, as: t, where: {x: {like: 1}, y: {between: {}}}}]", then="[{action: jump}]")))
    assert [(d.code, d.line) for d in e.value.diagnostics] == [("unknown-operator", 4), ("empty-range", 4), ("unknown-action", 5)]


@pytest.mark.parametrize("when,then,part", [
    ("[{fact: T, as: t}, {fact: U, as: t}]", None, "bound twice"), ("[{fact: T, as: t}, {fact: U, as: u, where: {x: {eq: {$ref: z.a}}}}]", None, "earlier alias"),
    ("[{fact: T, as: t, where: {x: {matches: '('}}}]", None, "no regular expression"), ("[{fact: T, as: t, where: {x: {matches: '(?=a)'}}}]", None, "look-around"),
    ("[{fact: T, as: t, condition: 'q.a > 1'}]", None, "isn't bound"), (None, "[{action: setField, target: q, field: a, value: 1}]", "binds no fact"),
    (None, "[{action: emit, event: e, payload: {a: {$ref: t}}}]", "a field of it is needed"), (None, "[{action: insertFact, fact: U, as: t, payload: {}}]", "is taken"),
    ("[{fact: T, as: t}, {fact: U, as: u, where: {x: {eq: {$ref: t.a, within: 5}}}}]", None, "no other operator"), ("[{fact: T, as: t, where: {a..b: {eq: 1}}}]", None, "empty segment"),
    ("[{fact: T, as: t}, {fact: U, as: u, quantifier: notExists, condition: 'true'}]", None, "binds a fact"), ("[{fact: T, as: t}, {fact: U, as: u, quantifier: accumulate}]", None, "need each other"),
])
def test_meaning(when, then, part):
    with pytest.raises(DslError) as e:
        load_rules(("f", rule(when or "[{fact: T, as: t}]", then or "[{action: emit, event: e}]")))
    assert part in str(e.value) and {d.code for d in e.value.diagnostics} == {"semantic"}


def test_report():
    text = rule(when="[{fact: T, as: t, where: {x: {gt: 5, lt: 3}, y: {ne: a}, z: {ne: 4}}}]")
    schemas = {"T": {"y": ("string", False), "z": ("string", True)}}
    codes = {w[0] for w in load_rules(("f", text), schemas=schemas).report.warnings}
    assert codes == {"impossible-range", "ne-on-optional-path", "vacuous-anti-match"}
    with pytest.raises(DslError):
        load_rules(("f", rule(when="[{fact: T, as: t, where: {y: {eq: 4}}}]")), schemas=schemas)
    with pytest.raises(DslError):
        load_rules(("f", rule(then="[{action: callFunction, name: f}]")), functions=("g",))
    chain = rule(when="[{fact: Never, as: t}]")
    assert compile_rules(load_rules(("f", chain)).rules, given=["T"]).report.unreachable == ("r",)
    with pytest.raises(CompileError):
        compile_rules(load_rules(("f", chain)).rules * 2)


def test_fact_documents():
    assert read_facts("f", "- {type: A, payload: {x: no, y: 1.50}}") == [("A", {"x": "no", "y": __import__("decimal").Decimal("1.50")})]
    with pytest.raises(DslError):
        read_facts("f", "- {type: A}\n- {type: B, payload: {}}")
