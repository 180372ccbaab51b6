"""Checks rules for meaning and makes the rule set: version, tested paths, warnings, reachability."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from ..functions.expressions import ExpressionError, parse, variables
from ..functions.values import kind, order, segments
from ..model import CallFunction, Emit, Expr, InsertFact, Join, Pattern, Range, Ref, Report, RetractFact, Rule, RuleSet, SetField, Test
from .reader import dumps_rules

LOOK_AROUND = re.compile(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k<|[*+?}]\+")


class CompileError(ValueError):
    def __init__(self, problems: list[tuple[str, str]]):
        super().__init__("\n".join(f"rule '{r}': {m}" for r, m in problems))
        self.problems = problems


def tested_paths(rule: Rule) -> dict[str, set[str]]:
    """By fact type, the paths whose change matters to a rule; '' (everything) for types that a condition reads."""
    out: dict[str, set[str]] = {}
    types = {p.alias: p.fact for p in rule.when}
    for p in rule.when:
        mine = out.setdefault(p.fact, set())
        for c in p.constraints:
            mine.add(c.path)
            if isinstance(c, Join) and c.ref.alias in types:
                out.setdefault(types[c.ref.alias], set()).add(c.ref.path or "")
        if p.fold and p.fold.path:
            mine.add(p.fold.path)
    if any(p.condition for p in rule.when):
        for p in rule.positives:
            out[p.fact].add("")
    return out


def touches(changed: str, tested: str) -> bool:
    """Whether a change at one path can alter what is tested at another: the same, above or below."""
    return changed == tested or not tested or not changed or changed.startswith(f"{tested}.") or tested.startswith(f"{changed}.")


def _check(rule: Rule, functions: tuple[str, ...] | None, fail) -> None:
    seen: dict[str, Pattern] = {}
    if not rule.when:
        fail("'when' is empty")
    if not rule.then:
        fail("'then' is empty")
    for p in rule.when:
        if (p.fold is not None) != (p.quantifier == "accumulate"):
            fail(f"'{p.alias}': an accumulate pattern and an accumulate block need each other")
        if p.alias in seen:
            fail(f"alias '{p.alias}' is bound twice")
        if p.condition and not p.positive:
            fail(f"'{p.alias}': a condition stands on a pattern that binds a fact")
        for c in p.constraints:
            try:
                segments(c.path)
            except ValueError as e:
                fail(str(e))
            if isinstance(c, Test):
                if c.op in ("in", "notIn") and not isinstance(c.value, (list, tuple)):
                    fail(f"'{c.path}': {c.op} needs an array")
                if c.op in ("hasField", "isNull") and not isinstance(c.value, bool):
                    fail(f"'{c.path}': {c.op} needs true or false")
                if c.op in ("after", "before"):
                    fail(f"'{c.path}': {c.op} needs a $ref")
                if c.op == "matches":
                    try:
                        re.compile(c.value)
                        if LOOK_AROUND.search(c.value):
                            fail(f"'{c.path}': look-around, possessive and back references aren't part of the pattern language")
                    except (re.error, TypeError) as e:
                        fail(f"'{c.path}': no regular expression: {e}")
            elif isinstance(c, Range):
                for bound in (c.low, c.high):
                    if bound is not None and kind(bound) not in ("number", "string"):
                        fail(f"'{c.path}': only numbers and strings are ordered")
            else:
                if c.op in ("matches", "hasField", "isNull"):
                    fail(f"'{c.path}': {c.op} can't compare with another fact")
                if (c.op in ("after", "before")) != (c.within is not None):
                    fail(f"'{c.path}': after and before need a within, no other operator has one")
                if c.within is not None and c.within <= 0:
                    fail(f"'{c.path}': within must be positive")
                other = seen.get(c.ref.alias)
                if other is None:
                    fail(f"'{c.path}': '{c.ref.alias}' is not an earlier alias")
                elif not other.positive:
                    fail(f"'{c.path}': '{c.ref.alias}' binds no fact to join to")
        if p.fold:
            if p.fold.function == "count" and p.fold.path is not None:
                fail(f"'{p.alias}': count takes no field")
            if p.fold.function != "count" and not p.fold.path:
                fail(f"'{p.alias}': {p.fold.function} needs a field")
            if p.fold.having and p.fold.having[0] not in ("eq", "ne", "gt", "gte", "lt", "lte"):
                fail(f"'{p.alias}': having can't use {p.fold.having[0]}")
        seen[p.alias] = p
    if rule.when and not rule.positives:
        fail("no pattern binds a fact")
    readable = {a for a, p in seen.items() if p.positive or p.quantifier == "accumulate"}

    def expression(text: str) -> None:
        try:
            for name in variables(parse(text)) - readable:
                fail(f"expression '{text}' reads '{name}', which isn't bound")
        except ExpressionError as e:
            fail(str(e))

    for p in rule.when:
        if p.condition is not None:
            expression(p.condition)
    made: dict[str, str] = {}

    def value(v) -> None:
        if isinstance(v, Expr):
            expression(v.text)
        elif isinstance(v, Ref):
            p = seen.get(v.alias)
            if v.alias in made:
                return
            if p is None or not (p.positive or p.quantifier == "accumulate"):
                fail(f"'{v.alias}' isn't bound")
            elif p.quantifier == "accumulate" and v.path is not None:
                fail(f"'{v.alias}' is an answer and has no fields")
            elif p.positive and v.path is None:
                fail(f"'{v.alias}' is a fact; a field of it is needed")

    for a in rule.then:
        if isinstance(a, (SetField, RetractFact)):
            p = seen.get(a.target)
            if a.target not in made and (p is None or not p.positive):
                fail(f"target '{a.target}' binds no fact")
        if isinstance(a, SetField):
            value(a.value)
        if isinstance(a, InsertFact):
            for _, v in a.payload:
                value(v)
            if a.alias:
                if a.alias in seen or a.alias in made:
                    fail(f"insertFact alias '{a.alias}' is taken")
                made[a.alias] = a.fact
        if isinstance(a, Emit):
            if not a.event:
                fail("emit needs an event")
            for _, v in a.payload:
                value(v)
        if isinstance(a, CallFunction):
            if functions is not None and a.name not in functions:
                fail(f"function '{a.name}' isn't declared")
            for _, v in a.args:
                value(v)


def _schema_problems(rule: Rule, schemas: dict[str, dict], fail, warn) -> None:
    """Literals that a known type can never equal. ``schemas``: by fact type, (JSON type, required) by path."""
    for p in rule.when:
        known = schemas.get(p.fact, {})
        for c in p.alphas:
            if c.path not in known:
                continue
            want, required = known[c.path]
            can = lambda v, want=want: kind(v) == want or (v is None and want == "null")
            if isinstance(c, Range):
                if any(b is not None and not can(b) for b in (c.low, c.high)):
                    fail(f"'{c.path}' of {p.fact} is a {want} and never in that range")
            elif c.op == "eq" and not can(c.value):
                fail(f"'{c.path}' of {p.fact} is a {want} and never equals {c.value!r}")
            elif c.op == "matches" and want != "string":
                fail(f"'{c.path}' of {p.fact} is a {want}, which no expression matches")
            elif c.op == "in" and not any(map(can, c.value)):
                fail(f"'{c.path}' of {p.fact} is a {want} and none of the list")
            elif (c.op == "ne" and not can(c.value)) or (c.op == "notIn" and not any(map(can, c.value))):
                warn("vacuous-anti-match", f"'{c.path}' of {p.fact} is a {want}: {c.op} always holds")
            elif c.op in ("ne", "notIn") and not required and not any(isinstance(x, Test) and (x.path, x.op, x.value) == (c.path, "hasField", True) for x in p.constraints):
                warn("ne-on-optional-path", f"'{c.path}' of {p.fact} may be absent, where {c.op} holds")


def _impossible(p: Pattern) -> Iterable[str]:
    lows, highs = {}, {}
    for c in p.alphas:
        if isinstance(c, Range):
            if c.low is not None:
                lows.setdefault(c.path, []).append((c.low, c.low_inclusive))
            if c.high is not None:
                highs.setdefault(c.path, []).append((c.high, c.high_inclusive))
    for path in lows.keys() & highs.keys():
        for low, li in lows[path]:
            for high, hi in highs[path]:
                c = order(low, high)
                if c is None or c > 0 or (c == 0 and not (li and hi)):
                    yield path


def compile_rules(rules: Iterable[Rule], functions: tuple[str, ...] | None = None, schemas: dict | None = None, given: Iterable[str] | None = None) -> RuleSet:
    """``functions``: names that callFunction may use, None for any; ``given``: fact types that callers insert, None: all that no rule makes."""
    rules = tuple(rules)
    problems: list[tuple[str, str]] = []
    warnings: list[tuple[str, str, str]] = []
    ids: set[str] = set()
    for r in rules:
        if r.id in ids:
            problems.append((r.id, "the id is used twice"))
        ids.add(r.id)
        _check(r, functions, lambda m, r=r: problems.append((r.id, m)))
        if schemas:
            _schema_problems(r, schemas, lambda m, r=r: problems.append((r.id, m)), lambda c, m, r=r: warnings.append((c, r.id, m)))
        for p in r.when:
            warnings += [("impossible-range", r.id, f"no value of '{path}' of '{p.alias}' is in all its ranges") for path in _impossible(p)]
    if problems:
        raise CompileError(problems)
    tested: dict[str, set[str]] = {}
    for r in rules:
        for t, paths in tested_paths(r).items():
            tested.setdefault(t, set()).update(paths)
    for r in rules:
        for t, paths in tested_paths(r).items():
            for path in sorted(paths):
                if any(o.startswith(f"{path}.") for o in tested[t]) and path:
                    warnings.append(("shallow-tested-path", r.id, f"'{path}' of {t} lies above another tested path"))
    reasons = {"ne": "not-equal", "notIn": "membership", "in": "membership", "after": "bounded", "before": "bounded", "gt": "range", "gte": "range", "lt": "range", "lte": "range"}
    unindexed = [(r.id, f"{p.alias}.{c.path}", reasons[c.op]) for r in rules for p in r.when for c in p.joins if c.op in reasons and not any(j.op == "eq" for j in p.joins)]
    made = {a.fact for r in rules for a in r.then if isinstance(a, InsertFact)}
    types = set(given) if given is not None else {p.fact for r in rules for p in r.when} - made
    reached: set[str] = set()
    while True:
        new = {r.id for r in rules if all(p.fact in types for p in r.positives)} - reached
        if not new:
            break
        reached |= new
        types |= {a.fact for r in rules if r.id in new for a in r.then if isinstance(a, InsertFact)}
    version = "sha256:" + hashlib.sha256(dumps_rules(tuple(sorted(rules, key=lambda r: r.id))).encode()).hexdigest()[:16]
    report = Report(tuple(warnings), tuple(unindexed), tuple(r.id for r in rules if r.id not in reached), {t: tuple(sorted(p)) for t, p in tested.items()})
    return RuleSet(rules, version, report)
