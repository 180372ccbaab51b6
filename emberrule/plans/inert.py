"""Rule sets whose actions no rule sees, fired as one Spark job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dsl.compiler import tested_paths, touches
from ..model import CallFunction, Emit, InsertFact, Ref, Rule, RuleSet, SetField
from .lhs import Matches, SourceMap, _name, _values, value_column


def changes_nothing(rule: Rule, rules: RuleSet) -> bool:
    """Whether none of a rule's effects can alter a match, the order, or what another action reads.

    Emitting and calling never do; inserting a type that no pattern names doesn't; setting a field doesn't if no rule tests
    it, anything above or below it, or reads it.
    """
    mentioned = {p.fact for r in rules.rules for p in r.when}
    types = {p.alias: p.fact for p in rule.when}
    for a in rule.then:
        if isinstance(a, (Emit, CallFunction)) or (isinstance(a, InsertFact) and a.fact not in mentioned and not a.logical):
            continue
        if isinstance(a, SetField) and a.target in types:
            fact = types[a.target]
            tested = {p for r in rules.rules for p in tested_paths(r).get(fact, ())}
            read = {v.path for r in rules.rules for b in r.then for v in _values(b) if isinstance(v, Ref) and v.path and {p.alias: p.fact for p in r.when}.get(v.alias) == fact}
            if not any(touches(a.path, p) for p in tested | read):
                continue
        return False
    return True


def fire_inert(rules: RuleSet, sources: SourceMap) -> DataFrame:
    """What such a rule set emits: session_id, seq, ordinal, event, payload (JSON), rule_id, handles, rule_set_version.

    ``seq`` is the firing's place in its session. Sessions are ranked apart, so their number doesn't matter; one that holds
    most facts is ranked in one task and is better divided by its unit of work. Rule sets that change facts are refused:
    ``operators.sessions`` runs those.
    """
    bad = [r.id for r in rules.rules if not changes_nothing(r, rules)]
    if bad:
        raise ValueError(f"rules {', '.join(bad)} change facts that rules see")
    parts = []
    for place, r in enumerate(sorted(rules.rules, key=lambda r: r.id.encode("utf-16-be"))):
        m = Matches(r, sources)
        df = m.build()
        newest: list[Column] = [F.col(f"`{_name(p.alias, '^')}`").cast("long") for p in r.positives]
        emits = [
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(a.event).alias("event"),
                (F.to_json(F.struct(*(value_column(v, m).alias(k) for k, v in a.payload)), {"ignoreNullFields": "false"}) if a.payload else F.lit("{}")).alias("payload"),
            )
            for i, a in enumerate(a for a in r.then if isinstance(a, Emit))
        ]
        none = F.array().cast("array<struct<ordinal:int,event:string,payload:string>>")
        parts.append(
            df.select(
                (F.col(f"`{_name(r.positives[0].alias, '$')}`").cast("string") if m.has_session else F.lit("")).alias("session_id"),
                F.lit(r.id).alias("rule_id"),
                F.lit(r.salience).alias("salience"),
                F.lit(place).alias("place"),
                (F.greatest(*newest) if len(newest) > 1 else newest[0]).alias("recency"),
                F.array(*(F.col(f"`{_name(p.alias, '#')}`").cast("long") for p in r.positives)).alias("handles"),
                (F.array(*emits) if emits else none).alias("emits"),
            )
        )
    order = Window.partitionBy("session_id").orderBy(F.desc("salience"), F.desc("recency"), "place", "handles")
    fired = reduce(DataFrame.unionByName, parts).withColumn("seq", F.row_number().over(order))
    out = fired.select("session_id", "seq", "rule_id", "handles", F.explode("emits").alias("e"))
    return out.select("session_id", "seq", "e.ordinal", "e.event", "e.payload", "rule_id", "handles", F.lit(rules.version).alias("rule_set_version"))
