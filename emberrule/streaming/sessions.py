"""Sessions over a stream of commands: each session's state stays between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.kernel import Options, Session
from ..functions.values import dumps
from ..model import RuleSet
from ..operators.sessions import _COLUMNS, OUTCOMES, apply_command, outcome_rows


def stream_sessions(commands: DataFrame, rules: RuleSet, options: Options | None = None, idle: str | None = None) -> DataFrame:
    """Outcomes of a stream of commands. What a micro-batch brings a session is applied in order, then it fires once.

    The session is kept in Spark's state store under its id, so a restart from the checkpoint goes on where it was.
    After ``idle`` without commands (a processing time, such as "1 hour") a session is dropped. A session that fails
    gives a status row and starts anew.
    """
    opts = options or Options()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session: Session = pickle.loads(state.get[0]) if state.exists else Session(rules, opts)
        session.options = opts
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out: list[tuple] = []
        status, error = "DRAINED", None
        try:
            for op, fact, handle, payload in [*zip(rows["op"], rows["type"], rows["handle"], rows["payload"], strict=True), ("fire", None, 0, None)]:
                result = apply_command(session, op, fact, handle, payload)
                if result is not None:
                    out += outcome_rows(key[0], rules.version, result)
                    status, error = result.reason, result.error
        except Exception as e:  # a failed session doesn't stop the stream
            out, status, error = [], "FAILED", f"{type(e).__name__}: {e}"
        if status == "FAILED":
            state.remove()
        else:
            session.options = Options()
            state.update((pickle.dumps(session),))
            if idle:
                state.setTimeoutDuration(idle)
        stats = dumps(session.stats | {"facts": len(session.facts)} | ({"error": error} if error else {}))
        out.append((key[0], None, 0, "status", None, None, status, stats, None, None, rules.version))
        frame = pd.DataFrame(out, columns=_COLUMNS)
        for c in ("seq", "recency"):
            frame[c] = frame[c].astype("Int64")
        yield frame

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return commands.groupBy("session_id").applyInPandasWithState(step, OUTCOMES, "session binary", "append", timeout)


def deliver(outcomes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands each micro-batch's outcomes to ``sink``; a batch may come again under the same number."""
    return outcomes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append")
