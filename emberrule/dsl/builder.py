"""Rules built in Python, equal to those read from files."""

from __future__ import annotations

from typing import Any

from ..model import Action, CallFunction, Constraint, Emit, Expr, Fold, InsertFact, Join, Literal, Pattern, Range, Ref, RetractFact, Rule, SetField, Test


def ref(text: str) -> Ref:
    alias, _, path = text.partition(".")
    return Ref(alias, path or None)


def expr(text: str) -> Expr:
    return Expr(text)


class Where:
    """Constraints of one pattern; each method adds one and returns self."""

    def __init__(self) -> None:
        self.constraints: list[Constraint] = []

    def _compare(self, path: str, op: str, value: Any) -> Where:
        if isinstance(value, Ref):
            self.constraints.append(Join(path, op, value))
        elif op in ("eq", "ne"):
            self.constraints.append(Test(path, op, value))
        else:
            low = op in ("gt", "gte")
            inclusive = op in ("gte", "lte")
            self.constraints.append(Range(path, value if low else None, None if low else value, inclusive if low else True, True if low else inclusive))
        return self

    def eq(self, path: str, value: Any) -> Where:
        return self._compare(path, "eq", value)

    def ne(self, path: str, value: Any) -> Where:
        return self._compare(path, "ne", value)

    def gt(self, path: str, value: Any) -> Where:
        return self._compare(path, "gt", value)

    def gte(self, path: str, value: Any) -> Where:
        return self._compare(path, "gte", value)

    def lt(self, path: str, value: Any) -> Where:
        return self._compare(path, "lt", value)

    def lte(self, path: str, value: Any) -> Where:
        return self._compare(path, "lte", value)

    def between(self, path: str, low: Any = None, high: Any = None, low_inclusive: bool = True, high_inclusive: bool = True) -> Where:
        for bound, op in ((low, "gte" if low_inclusive else "gt"), (high, "lte" if high_inclusive else "lt")):
            if isinstance(bound, Ref):
                self.constraints.append(Join(path, op, bound))
        low, high = (None if isinstance(b, Ref) else b for b in (low, high))
        if low is not None or high is not None:
            self.constraints.append(Range(path, low, high, low_inclusive if low is not None else True, high_inclusive if high is not None else True))
        return self

    def is_in(self, path: str, values: list | Ref) -> Where:
        self.constraints.append(Join(path, "in", values) if isinstance(values, Ref) else Test(path, "in", list(values)))
        return self

    def not_in(self, path: str, values: list | Ref) -> Where:
        self.constraints.append(Join(path, "notIn", values) if isinstance(values, Ref) else Test(path, "notIn", list(values)))
        return self

    def matches(self, path: str, pattern: str) -> Where:
        self.constraints.append(Test(path, "matches", pattern))
        return self

    def has_field(self, path: str, yes: bool = True) -> Where:
        self.constraints.append(Test(path, "hasField", yes))
        return self

    def is_null(self, path: str, yes: bool = True) -> Where:
        self.constraints.append(Test(path, "isNull", yes))
        return self

    def after(self, path: str, other: Ref, within: Any) -> Where:
        self.constraints.append(Join(path, "after", other, within))
        return self

    def before(self, path: str, other: Ref, within: Any) -> Where:
        self.constraints.append(Join(path, "before", other, within))
        return self


class RuleBuilder:
    def __init__(self, rule_id: str, salience: int = 0, no_loop: bool = False, tags: tuple[str, ...] = (), agenda_group: str | None = None):
        self.head = (rule_id, salience, no_loop, tags, agenda_group)
        self.patterns: list[Pattern] = []
        self.actions: list[Action] = []

    def _pattern(self, fact: str, alias: str, quantifier: str, where: Where | None, condition: str | None = None, fold: Fold | None = None) -> RuleBuilder:
        self.patterns.append(Pattern(fact, alias, quantifier, tuple(where.constraints if where else ()), condition, fold))
        return self

    def when(self, fact: str, alias: str, where: Where | None = None, condition: str | None = None) -> RuleBuilder:
        return self._pattern(fact, alias, "exists", where, condition)

    def when_not(self, fact: str, alias: str, where: Where | None = None) -> RuleBuilder:
        return self._pattern(fact, alias, "notExists", where)

    def for_all(self, fact: str, alias: str, where: Where | None = None) -> RuleBuilder:
        return self._pattern(fact, alias, "forAll", where)

    def accumulate(self, fact: str, alias: str, function: str, path: str | None = None, having: tuple[str, Any] | None = None, where: Where | None = None) -> RuleBuilder:
        return self._pattern(fact, alias, "accumulate", where, None, Fold(function, path, having))

    def set_field(self, target: str, path: str, value: Any) -> RuleBuilder:
        self.actions.append(SetField(target, path, _value(value)))
        return self

    def insert(self, fact: str, alias: str | None = None, logical: bool = False, **payload: Any) -> RuleBuilder:
        self.actions.append(InsertFact(fact, _pairs(payload), alias, logical))
        return self

    def retract(self, target: str) -> RuleBuilder:
        self.actions.append(RetractFact(target))
        return self

    def emit(self, event: str, **payload: Any) -> RuleBuilder:
        self.actions.append(Emit(event, _pairs(payload)))
        return self

    def call(self, name: str, **args: Any) -> RuleBuilder:
        self.actions.append(CallFunction(name, _pairs(args)))
        return self

    def build(self) -> Rule:
        rule_id, salience, no_loop, tags, group = self.head
        return Rule(rule_id, tuple(self.patterns), tuple(self.actions), salience, no_loop, tags, group)


def _value(v: Any):
    return v if isinstance(v, (Ref, Expr, Literal)) else Literal(v)


def _pairs(values: dict[str, Any]):
    return tuple((k, _value(v)) for k, v in values.items())
