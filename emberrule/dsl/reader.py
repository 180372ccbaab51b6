"""Reads rule files: YAML or JSON text to rules, with every problem's code and place reported together."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from decimal import Decimal
from pathlib import Path
from typing import Any

import yaml

from ..model import (
    ACTIONS, COMPARE, FOLDS, OPERATORS, QUANTIFIERS, Action, CallFunction, Constraint, Emit, Expr, Fold, InsertFact, Join, Literal, Pattern, Range,
    Ref, RetractFact, Rule, SetField, Test, Value,
)

API_VERSION = "rules.v1"
RULE_KEYS = ("id", "salience", "noLoop", "agendaGroup", "tags", "when", "then")
PATTERN_KEYS = ("fact", "as", "quantifier", "where", "condition", "accumulate")
ACTION_KEYS = {
    "setField": (("target", "field", "value"), ()),
    "insertFact": (("fact", "payload"), ("as", "logical")),
    "retractFact": (("target",), ()),
    "emit": (("event",), ("payload",)),
    "callFunction": (("name",), ("args",)),
}


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    source: str = ""
    pointer: str = ""
    line: int = 0
    column: int = 0

    def __str__(self) -> str:
        return f"{self.source}:{self.line}:{self.column}: {self.code}: {self.message}"


class DslError(ValueError):
    def __init__(self, diagnostics: list[Diagnostic]):
        super().__init__("\n".join(map(str, diagnostics)))
        self.diagnostics = tuple(diagnostics)


class _Loader(yaml.SafeLoader):
    """Only true and false are booleans, numbers with a fraction are exact, dates stay text."""


_Loader.yaml_implicit_resolvers = {
    k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|false)$"), list("tf"))


def read_document(text: str, source: str = "") -> tuple[Any, dict[str, tuple[int, int]]]:
    """One YAML or JSON document (JSON is read as YAML) and the places of its values by JSON pointer."""
    places: dict[str, tuple[int, int]] = {}

    def fail(message: str, mark: Any) -> DslError:
        line, column = (mark.line + 1, mark.column + 1) if mark else (0, 0)
        return DslError([Diagnostic("malformed-document", message, source, "", line, column)])

    def build(node: yaml.Node, pointer: str) -> Any:
        places[pointer] = (node.start_mark.line + 1, node.start_mark.column + 1)
        if isinstance(node, yaml.MappingNode):
            out: dict[str, Any] = {}
            for key, value in node.value:
                if not isinstance(key, yaml.ScalarNode):
                    raise fail("keys are text", key.start_mark)
                if key.value in out:
                    raise fail(f"duplicate key '{key.value}'", key.start_mark)
                out[key.value] = build(value, f"{pointer}/{key.value.replace('~', '~0').replace('/', '~1')}")
            return out
        if isinstance(node, yaml.SequenceNode):
            return [build(v, f"{pointer}/{i}") for i, v in enumerate(node.value)]
        if node.tag == "tag:yaml.org,2002:float" and re.fullmatch(r"[-+]?[0-9.]+(?:[eE][-+]?\d+)?", node.value):
            return Decimal(node.value)
        return loader.construct_object(node)

    loader = _Loader(text)
    try:
        if not loader.check_node():
            raise fail("the document is empty", None)
        root = loader.get_node()
        out = build(root, "")
        if loader.check_node():
            raise fail("one document a file", loader.peek_event().start_mark)
        return out, places
    except yaml.YAMLError as e:
        raise fail(getattr(e, "problem", None) or str(e), getattr(e, "problem_mark", None)) from None
    finally:
        loader.dispose()


class _Reader:
    def __init__(self, source: str, places: dict[str, tuple[int, int]]):
        self.source, self.places, self.problems = source, places, []

    def problem(self, code: str, message: str, pointer: str) -> None:
        at = pointer
        while at not in self.places and at:
            at = at.rpartition("/")[0]
        self.problems.append(Diagnostic(code, message, self.source, pointer, *self.places.get(at, (0, 0))))

    def shape(self, node: Any, required: tuple[str, ...], optional: tuple[str, ...], pointer: str, what: str) -> bool:
        if not isinstance(node, dict):
            self.problem("schema-violation", f"{what} must be an object", pointer)
            return False
        fine = True
        for k in required:
            if k not in node:
                self.problem("schema-violation", f"{what} needs '{k}'", pointer)
                fine = False
        for k in node:
            if k not in required + optional:
                self.problem("schema-violation", f"{what} has no '{k}'", f"{pointer}/{k}")
                fine = False
        return fine

    def typed(self, node: dict, key: str, kind: Any, pointer: str, what: str) -> Any:
        value = node.get(key)
        wrong = value is not None and (not isinstance(value, kind) or (kind is int and isinstance(value, bool)))
        if wrong or (key in node and value is None) or (kind is str and value == "" and key != "condition") or (kind is list and value == [] and key in ("when", "then")):
            self.problem("schema-violation", f"'{key}' of {what} has the wrong type", f"{pointer}/{key}")
            return None
        return value

    def rule(self, node: Any, pointer: str) -> Rule | None:
        before = len(self.problems)
        if not self.shape(node, ("id", "when", "then"), RULE_KEYS, pointer, "a rule"):
            return None
        get = lambda k, t: self.typed(node, k, t, pointer, "a rule")
        rule_id, when, then = get("id", str), get("when", list), get("then", list)
        salience, no_loop, group, tags = get("salience", int), get("noLoop", bool), get("agendaGroup", str), get("tags", list)
        patterns = [self.pattern(p, f"{pointer}/when/{i}") for i, p in enumerate(when or [])]
        actions = [self.action(a, f"{pointer}/then/{i}") for i, a in enumerate(then or [])]
        if len(self.problems) > before:
            return None
        return Rule(rule_id, tuple(patterns), tuple(actions), salience or 0, bool(no_loop), tuple(tags or ()), group)

    def pattern(self, node: Any, pointer: str) -> Pattern | None:
        if not self.shape(node, ("fact", "as"), PATTERN_KEYS, pointer, "a pattern"):
            return None
        quantifier = node.get("quantifier", "exists")
        if quantifier not in QUANTIFIERS:
            self.problem("unknown-quantifier", f"'{quantifier}' is none of {', '.join(QUANTIFIERS)}", f"{pointer}/quantifier")
        fact, alias = (self.typed(node, k, str, pointer, "a pattern") for k in ("fact", "as"))
        where = self.typed(node, "where", dict, pointer, "a pattern") or {}
        constraints: list[Constraint] = []
        for field, operators in where.items():
            constraints += self.operators(field, operators, f"{pointer}/where/{field}")
        fold = self.fold(node["accumulate"], f"{pointer}/accumulate") if "accumulate" in node else None
        return Pattern(fact, alias, quantifier, tuple(constraints), self.typed(node, "condition", str, pointer, "a pattern"), fold)

    def fold(self, node: Any, pointer: str) -> Fold | None:
        if not isinstance(node, dict) or any(k not in (*FOLDS, "having") for k in node):
            self.problem("malformed-accumulate", f"accumulate takes one of {', '.join(FOLDS)}, and having", pointer)
            return None
        chosen = [k for k in FOLDS if k in node and node[k] is not False]
        if len(chosen) != 1:
            self.problem("malformed-accumulate", f"accumulate needs exactly one function, not {len(chosen)}", pointer)
            return None
        having = None
        if "having" in node:
            h = node["having"]
            if not isinstance(h, dict) or len(h) != 1 or next(iter(h)) not in COMPARE or isinstance(next(iter(h.values())), (dict, list)):
                self.problem("malformed-accumulate", f"having takes one of {', '.join(COMPARE)} and a literal", f"{pointer}/having")
            else:
                having = next(iter(h.items()))
        name = chosen[0]
        return Fold(name, None if name == "count" else node[name], having)

    def operators(self, field: str, node: Any, pointer: str) -> list[Constraint]:
        if not isinstance(node, dict) or not node:
            self.problem("malformed-operand", f"'{field}' needs an operator map", pointer)
            return []
        out: list[Constraint] = []
        for op, operand in node.items():
            at = f"{pointer}/{op}"
            if op not in OPERATORS:
                self.problem("unknown-operator", f"'{op}' is none of {', '.join(OPERATORS)}", at)
            elif op == "between":
                out += self.between(field, operand, at)
            elif op in ("after", "before"):
                if not isinstance(operand, dict) or set(operand) != {"$ref", "within"} or isinstance(operand["within"], bool) or not isinstance(operand["within"], (int, Decimal)) or operand["within"] <= 0:
                    self.problem("malformed-operand", f"'{op}' needs a $ref and a positive within", at)
                elif ref := self.reference(operand["$ref"], at):
                    out.append(Join(field, op, ref, operand["within"]))
            elif op in ("in", "notIn", "matches", "hasField", "isNull"):
                need = {"in": list, "notIn": list, "matches": str}.get(op, bool)
                if not isinstance(operand, need):
                    self.problem("malformed-operand", f"'{op}' needs a {need.__name__}", at)
                else:
                    out.append(Test(field, op, self.literal(operand, at)))
            elif isinstance(operand, dict) and "$ref" in operand:
                if set(operand) != {"$ref"} and set(operand) != {"$ref", "within"}:
                    self.problem("unknown-dollar-key", "a $ref stands alone", at)
                elif ref := self.reference(operand["$ref"], at):
                    out.append(Join(field, op, ref, operand.get("within")))
            else:
                value = self.literal(operand, at)
                if op in ("eq", "ne"):
                    out.append(Test(field, op, value))
                elif isinstance(value, bool) or not isinstance(value, (int, Decimal, str)):
                    self.problem("malformed-operand", f"'{op}' orders numbers and strings only", at)
                else:
                    low = op in ("gt", "gte")
                    inclusive = op in ("gte", "lte")
                    out.append(Range(field, value if low else None, None if low else value, inclusive if low else True, True if low else inclusive))
        return out

    def between(self, field: str, node: Any, pointer: str) -> list[Constraint]:
        if not isinstance(node, dict) or set(node) - {"from", "to", "fromInclusive", "toInclusive"}:
            self.problem("malformed-operand", "between takes from, to, fromInclusive and toInclusive", pointer)
            return []
        if "from" not in node and "to" not in node:
            self.problem("empty-range", "between needs from or to", pointer)
            return []
        joins: list[Constraint] = []
        bounds: dict[str, Any] = {}
        for key, ops in (("from", ("gt", "gte")), ("to", ("lt", "lte"))):
            inclusive = node.get(f"{key}Inclusive", True)
            value = node.get(key)
            if isinstance(value, dict) and "$ref" in value:
                if "within" in value:
                    self.problem("malformed-reference", "a bound of between has no within", f"{pointer}/{key}")
                elif ref := self.reference(value["$ref"], f"{pointer}/{key}"):
                    joins.append(Join(field, ops[inclusive], ref))
            elif key in node:
                bounds[key] = self.literal(value, f"{pointer}/{key}")
        if bounds:
            joins.append(Range(field, bounds.get("from"), bounds.get("to"), node.get("fromInclusive", True) if "from" in bounds else True, node.get("toInclusive", True) if "to" in bounds else True))
        return joins

    def reference(self, text: Any, pointer: str, bare: bool = False) -> Ref | None:
        if isinstance(text, str):
            alias, dot, path = text.partition(".")
            if alias and ((dot and path and "" not in path.split(".")) or (bare and not dot)):
                return Ref(alias, path if dot else None)
        self.problem("malformed-reference", f"'{text}' is no alias.field", pointer)
        return None

    def literal(self, v: Any, pointer: str) -> Any:
        if isinstance(v, dict):
            return {self.key(k, pointer): self.literal(x, f"{pointer}/{k}") for k, x in v.items()}
        if isinstance(v, list):
            return [self.literal(x, f"{pointer}/{i}") for i, x in enumerate(v)]
        return v

    def key(self, k: str, pointer: str) -> str:
        if k.startswith("$$"):
            return k[1:]
        if k.startswith("$"):
            self.problem("unknown-dollar-key", f"'{k}' means nothing here; a key that starts with $ is written $${k[1:]}", pointer)
        return k

    def value(self, v: Any, pointer: str) -> Value:
        if isinstance(v, dict) and "$ref" in v:
            if set(v) != {"$ref"}:
                self.problem("unknown-dollar-key", "a $ref stands alone", pointer)
            return self.reference(v["$ref"], pointer, bare=True) or Literal(None)
        if isinstance(v, dict) and "$expr" in v:
            if set(v) != {"$expr"} or not isinstance(v["$expr"], str):
                self.problem("unknown-dollar-key", "a $expr is a text and stands alone", pointer)
            return Expr(str(v["$expr"]))
        return Literal(self.literal(v, pointer))

    def payload(self, node: Any, pointer: str) -> tuple[tuple[str, Value], ...]:
        if node is None:
            return ()
        if not isinstance(node, dict):
            self.problem("schema-violation", "a payload is an object", pointer)
            return ()
        return tuple((self.key(k, pointer), self.value(v, f"{pointer}/{k}")) for k, v in node.items())

    def action(self, node: Any, pointer: str) -> Action | None:
        name = node.get("action") if isinstance(node, dict) else None
        if name not in ACTIONS:
            self.problem("unknown-action", f"'{name}' is none of {', '.join(ACTIONS)}", pointer)
            return None
        required, optional = ACTION_KEYS[name]
        missing = [k for k in required if k not in node]
        extra = [k for k in node if k not in (*required, *optional, "action")]
        if missing or extra:
            self.problem("malformed-action", f"{name} " + ", ".join([f"needs '{k}'" for k in missing] + [f"has no '{k}'" for k in extra]), pointer)
            return None
        if name == "setField":
            return SetField(node["target"], node["field"], self.value(node["value"], f"{pointer}/value"))
        if name == "insertFact":
            return InsertFact(node["fact"], self.payload(node["payload"], f"{pointer}/payload"), node.get("as"), node.get("logical", False))
        if name == "retractFact":
            return RetractFact(node["target"])
        if name == "emit":
            return Emit(node["event"], self.payload(node.get("payload"), f"{pointer}/payload"))
        return CallFunction(node["name"], self.payload(node.get("args"), f"{pointer}/args"))


def read_rules(text: str, source: str = "rules.yaml") -> tuple[list[Rule], dict[str, tuple[str, int, int]]]:
    """The rules of one file and where each stands. Raises DslError with all problems."""
    node, places = read_document(text, source)
    reader = _Reader(source, places)
    if not isinstance(node, dict) or node.get("apiVersion") != API_VERSION:
        reader.problem("unknown-api-version", f"apiVersion must be {API_VERSION}", "/apiVersion")
        raise DslError(reader.problems)
    reader.shape(node, ("apiVersion", "rules"), (), "", "a rule file")
    listed = node.get("rules")
    if not isinstance(listed, list) or not listed:
        reader.problem("schema-violation", "'rules' is a list with a rule at least", "/rules")
        raise DslError(reader.problems)
    rules = [reader.rule(r, f"/rules/{i}") for i, r in enumerate(listed)]
    if reader.problems:
        raise DslError(reader.problems)
    return rules, {r.id: (source, *places[f"/rules/{i}"]) for i, r in enumerate(rules)}


def load_rules(*sources: str | Path | tuple[str, str], functions: tuple[str, ...] | None = None, schemas: dict | None = None):
    """Compile rule files: paths ending in .json, .yaml or .yml, or (name, text) pairs. Files unite to one rule set."""
    from .compiler import CompileError, compile_rules

    rules: list[Rule] = []
    where: dict[str, tuple[str, int, int]] = {}
    problems: list[Diagnostic] = []
    for s in sources:
        if isinstance(s, tuple):
            name, text = s
        else:
            if Path(s).suffix not in (".json", ".yaml", ".yml"):
                raise DslError([Diagnostic("malformed-document", "a rule file ends in .json, .yaml or .yml", str(s))])
            name, text = str(s), Path(s).read_text(encoding="utf-8")
        try:
            found, at = read_rules(text, name)
            rules += found
            where |= {k: v for k, v in at.items() if k not in where}
        except DslError as e:
            problems += e.diagnostics
    if problems:
        raise DslError(problems)
    try:
        return compile_rules(rules, functions=functions, schemas=schemas)
    except CompileError as e:
        raise DslError([Diagnostic("semantic", m, where.get(r, ("", 0, 0))[0], "", *where.get(r, ("", 0, 0))[1:]) for r, m in e.problems]) from None


def dumps_rules(rules: tuple[Rule, ...]) -> str:
    """A canonical JSON form of rules, the source of their version."""

    def plain(x: Any) -> Any:
        if hasattr(x, "__dataclass_fields__"):
            return {"_": type(x).__name__} | {k: plain(getattr(x, k)) for k in x.__dataclass_fields__}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in sorted(x.items())}
        if isinstance(x, (int, Decimal, float)) and not isinstance(x, bool):
            d = Decimal(str(x)).normalize()
            return {"#": f"{d:f}"}
        return x

    return json.dumps([plain(r) for r in rules], sort_keys=True, ensure_ascii=False)
