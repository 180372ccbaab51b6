"""Why a rule has no match: counts by pattern and constraint, set-wise, and a verdict."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernel import Session, passes
from ..model import Rule
from ..plans.lhs import SourceMap, matches
from .predicates import cell, test_column


def explain_counts(rule: Rule, sources: SourceMap) -> DataFrame:
    """By pattern: alias, considered, survivors, and worst: the constraint at which most facts fail first, with their number."""
    parts = None
    for p in rule.when:
        source = sources[p.fact]
        tests = [F.coalesce(test_column(cell(source.rows, t.path, source.finite), t), F.lit(False)) for t in p.alphas]
        so_far = F.lit(True)
        columns = [F.count(F.lit(1)).alias("considered")]
        fails = []
        for t, c in zip(p.alphas, tests, strict=True):
            fails.append(F.struct(F.count_if(so_far & ~c).alias("n"), F.lit(f"{t.path} {getattr(t, 'op', 'range')}").alias("constraint")))
            so_far = so_far & c
        columns.append(F.count_if(so_far).alias("survivors"))
        worst = F.array_max(F.array(*fails)) if fails else F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("constraint"))
        row = source.rows.agg(*columns, worst.alias("w"))
        row = row.select(F.lit(p.alias).alias("alias"), "considered", "survivors", F.when(F.col("w.n") > 0, F.col("w.constraint")).alias("worst"), F.col("w.n").alias("eliminated"))
        parts = row if parts is None else parts.unionByName(row)
    assert parts is not None
    return parts


def match_counts(rule: Rule, sources: SourceMap) -> dict[str, int]:
    """Complete tuples by joins alone, after quantifiers, and after conditions."""
    bare = replace(rule, when=tuple(replace(p, condition=None) for p in rule.positives), then=())
    asked = replace(rule, when=tuple(replace(p, condition=None) for p in rule.when), then=())
    return {k: matches(r, sources).count() for k, r in (("joined", bare), ("quantified", asked), ("matched", replace(rule, then=())))}


@dataclass(frozen=True)
class Verdict:
    reason: str
    alias: str | None = None
    detail: str = ""
    complete: bool = True


def why_not(session: Session, rule_id: str, pinned: dict[str, int] | None = None) -> Verdict:
    """The first reason why a rule isn't about to fire in a session; ``pinned`` asks about given facts by alias."""
    rule = session.rules[rule_id]
    for alias, h in (pinned or {}).items():
        p = next((x for x in rule.when if x.alias == alias), None)
        if p is None or not p.positive:
            return Verdict("not-a-fact-alias", alias)
        if h not in session.facts:
            return Verdict("unknown-fact", alias, f"no fact {h}" + (f"; {session.evicted} evicted" if session.evicted else ""))
        if session.facts[h].type != p.fact:
            return Verdict("wrong-type", alias, f"fact {h} is a {session.facts[h].type}")
        failed = next((t for t in p.alphas if not passes(t, session.facts[h].payload)), None)
        if failed:
            return Verdict("pinned-fact-fails", alias, f"{failed.path}")
    for p in rule.positives:
        facts = session._by_type.get(p.fact, {})
        if not facts:
            return Verdict("no-fact", p.alias, f"no {p.fact}" + (f"; {session.evicted[p.fact]} evicted" if p.fact in session.evicted else ""))
        if not session.passing(p):
            first = [next(t for t in p.alphas if not passes(t, f.payload)).path for f in facts.values()]
            worst = max(sorted(set(first)), key=first.count)
            return Verdict("no-survivor", p.alias, f"{first.count(worst)} of {len(facts)} fail at {worst}")
    bare = replace(rule, when=tuple(replace(p, condition=None) for p in rule.positives))
    fits = lambda h: all(h[[p.alias for p in rule.positives].index(a)] == x for a, x in (pinned or {}).items())
    tuples = [h for h, _ in session.matches(bare) if fits(h)]
    if not tuples:
        return Verdict("no-join", None, "every pattern has facts, but none join")
    no_condition = replace(rule, when=tuple(replace(p, condition=None) for p in rule.when))
    asked = [h for h in tuples if session.holds(no_condition, session._bound(rule, h) or {}) is not None]
    if not asked:
        return Verdict("quantifier", next(p.alias for p in rule.when if not p.positive), f"{len(tuples)} joined, none passes")
    held = [h for h in asked if session.holds(rule, session._bound(rule, h) or {}) is not None]
    if not held:
        return Verdict("condition", next(p.alias for p in rule.when if p.condition), f"{len(asked)} reached it")
    if all((rule.id, h) in session.fired for h in held):
        return Verdict("already-fired", None, f"{len(held)} matches have fired")
    return Verdict("eligible", None, f"{sum((rule.id, h) not in session.fired for h in held)} matches will fire")
