"""Many sessions as one job: each session's commands go to one task, which runs its firings.

A session's firings depend on each other and on their order, which no set of joins expresses; this is the one place
where rules run outside Spark's own operators. Rule sets whose actions change no fact that a rule sees need it not: see
``plans.lhs.ranked`` and ``plans.lhs.emitted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernel import Options, Result, Session
from ..functions.values import dumps, loads
from ..model import RuleSet

#: Commands: op is insert, update, retract or fire; handle is of updates and retracts, counted from 0 by session.
COMMANDS = "session_id string, seq long, op string, type string, handle long, payload string"
#: Outcomes: what is firing, emit, set, insert, retract, call, fact (one that is there at the end) or status.
OUTCOMES = (
    "session_id string, seq long, ordinal int, what string, rule_id string, handles array<long>, name string, payload string, "
    "origin string, recency long, rule_set_version string"
)
_COLUMNS = [c.split()[0] for c in OUTCOMES.split(", ")]


def apply_command(session: Session, op: str, fact: str, handle: int, payload: str | None) -> Result | None:
    if op == "insert":
        session.insert(fact, loads(payload or "{}"))
    elif op == "update":
        session.update(int(handle), loads(payload or "{}"))
    elif op == "retract":
        session.retract(int(handle))
    elif op == "fire":
        return session.fire()
    else:
        raise ValueError(f"no command '{op}'")
    return None


def outcome_rows(session_id: str, version: str, result: Result) -> Iterator[tuple]:
    for f in result.firings:
        head = (session_id, f.seq)
        tail = (None, None, version)
        yield (*head, -1, "firing", f.rule_id, list(f.handles), None, f.error, *tail)
        for i, e in enumerate(f.effects):
            what = e[0]
            name = e[1] if what in ("emit", "call") else e[2] if what in ("set", "insert") else None
            payload = dumps(e[3]) if what in ("set", "insert") else dumps(e[2]) if what in ("emit", "call") else None
            handles = list(f.handles) if what in ("emit", "call") else [e[1]]
            yield (*head, i, what, f.rule_id, handles, name, payload, *tail)


def fact_rows(session_id: str, version: str, session: Session) -> Iterator[tuple]:
    for h, f in sorted(session.facts.items()):
        yield (session_id, None, 0, "fact", None, [h], f.type, dumps(f.payload), f.origin, f.recency, version)


def run_sessions(commands: DataFrame, rules: RuleSet, options: Options | None = None) -> DataFrame:
    """The outcomes of all sessions in ``commands``; a session fires once more after its last command.

    A session that fails has a status row with the error and no other rows; the others aren't concerned.
    """
    opts = options or Options()

    def one(session_id: str, commands: list[tuple]) -> list[tuple]:
        session = Session(rules, replace(opts))
        out: list[tuple] = []
        status, error = "DRAINED", None
        try:
            for op, fact, handle, payload in [*commands, ("fire", None, 0, None)]:
                result = apply_command(session, op, fact, handle, payload)
                if result is not None:
                    out += outcome_rows(session_id, rules.version, result)
                    status, error = result.reason, result.error
            out += fact_rows(session_id, rules.version, session)
        except Exception as e:  # one input's failure is its own outcome
            out, status, error = [], "FAILED", f"{type(e).__name__}: {e}"
        stats = dumps(session.stats | {"facts": len(session.facts)} | ({"error": error} if error else {}))
        return [*out, (session_id, None, 0, "status", None, None, status, stats, None, None, rules.version)]

    def frame(out: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(out, columns=_COLUMNS)
        for c in ("seq", "recency"):
            f[c] = f[c].astype("Int64")
        return f

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by session; one session at a time is held."""
        current: str | None = None
        held: list[tuple] = []
        out: list[tuple] = []
        for b in batches:
            for sid, *command in zip(b["session_id"], b["op"], b["type"], b["handle"], b["payload"], strict=True):
                if sid != current and held:
                    out += one(current, held)
                    held = []
                    if len(out) >= 10_000:
                        yield frame(out)
                        out = []
                current = sid
                held.append(tuple(command))
        if held:
            out += one(current, held)
        if out:
            yield frame(out)

    rows = commands.select("session_id", "seq", "op", "type", "handle", "payload").repartition("session_id")
    return rows.sortWithinPartitions("session_id", "seq").mapInPandas(run, OUTCOMES)


def fact_commands(rows: DataFrame, session: str, fact: str, order: str, columns: dict[str, str], phase: int = 0) -> DataFrame:
    """Insert commands for the rows of a table: payload fields by SQL expressions. ``phase`` sorts tables one after another."""
    payload = F.to_json(F.struct(*(F.expr(e).alias(k) for k, e in columns.items())), {"ignoreNullFields": "false"})
    return rows.select(
        F.expr(session).cast("string").alias("session_id"),
        (F.expr(order).cast("long") + phase * (1 << 40)).alias("seq"),
        F.lit("insert").alias("op"),
        F.lit(fact).alias("type"),
        F.lit(None).cast("long").alias("handle"),
        payload.alias("payload"),
    )


def fire_commands(rows: DataFrame, session: str, phase: int) -> DataFrame:
    return rows.select(
        F.expr(session).cast("string").alias("session_id"),
        F.lit(phase * (1 << 40) - 1).alias("seq"),
        F.lit("fire").alias("op"),
        *(F.lit(None).cast(t).alias(n) for n, t in (("type", "string"), ("handle", "long"), ("payload", "string"))),
    ).distinct()


def export_facts(outcomes: DataFrame) -> DataFrame:
    """The asserted facts at the end, as insert commands for another run."""
    kept = outcomes.filter("what = 'fact' and origin = 'ASSERTED'")
    return kept.select("session_id", F.col("handles")[0].alias("seq"), F.lit("insert").alias("op"), F.col("name").alias("type"), F.lit(None).cast("long").alias("handle"), "payload")
