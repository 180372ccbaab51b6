"""Rules as data: frozen trees that the DSL reader and the builder make and that plans and sessions run."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

# The operator names of rule files.
COMPARE = ("eq", "ne", "gt", "gte", "lt", "lte")
OPERATORS = (*COMPARE, "between", "in", "notIn", "matches", "hasField", "isNull", "after", "before")
QUANTIFIERS = ("exists", "notExists", "forAll", "accumulate")
FOLDS = ("sum", "count", "min", "max", "average")
ACTIONS = ("setField", "insertFact", "retractFact", "emit", "callFunction")


@dataclass(frozen=True)
class Ref:
    alias: str
    path: str | None = None  # None: an accumulate alias's answer


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Expr:
    text: str


Value = Literal | Ref | Expr


@dataclass(frozen=True)
class Test:
    """A test of one field against literals."""

    path: str
    op: str
    value: Any


@dataclass(frozen=True)
class Range:
    path: str
    low: Any = None
    high: Any = None
    low_inclusive: bool = True
    high_inclusive: bool = True


@dataclass(frozen=True)
class Join:
    """A test of one field against a field of an earlier pattern; ``within`` for after and before."""

    path: str
    op: str
    ref: Ref
    within: Any = None


Constraint = Test | Range | Join


@dataclass(frozen=True)
class Fold:
    function: str
    path: str | None = None
    having: tuple[str, Any] | None = None


@dataclass(frozen=True)
class Pattern:
    fact: str
    alias: str
    quantifier: str = "exists"
    constraints: tuple[Constraint, ...] = ()
    condition: str | None = None
    fold: Fold | None = None

    @property
    def positive(self) -> bool:
        return self.quantifier == "exists"

    @cached_property
    def alphas(self) -> tuple[Test | Range, ...]:
        return tuple(c for c in self.constraints if not isinstance(c, Join))

    @cached_property
    def joins(self) -> tuple[Join, ...]:
        return tuple(c for c in self.constraints if isinstance(c, Join))


@dataclass(frozen=True)
class SetField:
    target: str
    path: str
    value: Value


@dataclass(frozen=True)
class InsertFact:
    fact: str
    payload: tuple[tuple[str, Value], ...]
    alias: str | None = None
    logical: bool = False


@dataclass(frozen=True)
class RetractFact:
    target: str


@dataclass(frozen=True)
class Emit:
    event: str
    payload: tuple[tuple[str, Value], ...] = ()


@dataclass(frozen=True)
class CallFunction:
    name: str
    args: tuple[tuple[str, Value], ...] = ()


Action = SetField | InsertFact | RetractFact | Emit | CallFunction


@dataclass(frozen=True)
class Rule:
    id: str
    when: tuple[Pattern, ...]
    then: tuple[Action, ...]
    salience: int = 0
    no_loop: bool = False
    tags: tuple[str, ...] = ()
    agenda_group: str | None = None  # kept and part of the version, otherwise without effect

    @cached_property
    def positives(self) -> tuple[Pattern, ...]:
        return tuple(p for p in self.when if p.positive)


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    version: str
    report: Report = field(compare=False, default=None)  # type: ignore[assignment]

    def __getitem__(self, rule_id: str) -> Rule:
        return next(r for r in self.rules if r.id == rule_id)


@dataclass(frozen=True)
class Report:
    """What the compiler found besides errors."""

    warnings: tuple[tuple[str, str, str], ...] = ()  # code, rule, text
    unindexed: tuple[tuple[str, str, str], ...] = ()  # rule, alias.path, reason
    unreachable: tuple[str, ...] = ()
    tested_paths: dict[str, tuple[str, ...]] = field(default_factory=dict)
