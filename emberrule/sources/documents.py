"""Facts from documents and feeds, and facts written out again."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl.reader import Diagnostic, DslError, read_document
from ..functions.values import dumps
from ..operators.sessions import COMMANDS


def read_facts(source: str | Path, text: str | None = None) -> list[tuple[str, Any]]:
    """(type, payload) of each entry of a YAML or JSON list, in order. One wrong entry refuses the whole document."""
    if text is None:
        text = Path(source).read_text(encoding="utf-8")
    node, places = read_document(text, str(source))
    if not isinstance(node, list):
        raise DslError([Diagnostic("malformed-document", "a fact document is a list", str(source))])
    problems = []
    for i, entry in enumerate(node):
        if not isinstance(entry, dict) or set(entry) != {"type", "payload"} or not isinstance(entry["type"], str) or not isinstance(entry["payload"], dict):
            problems.append(Diagnostic("schema-violation", "an entry has a type and a payload object", str(source), f"/{i}", *places[f"/{i}"]))
    if problems:
        raise DslError(problems)
    return [(e["type"], e["payload"]) for e in node]


def read_payload(text: str, source: str = "") -> Any:
    return read_document(text, source)[0]


def facts_frame(spark: SparkSession, facts: list[tuple[str, Any]], session_id: str = "") -> DataFrame:
    rows = [(session_id, i, "insert", t, None, dumps(p)) for i, (t, p) in enumerate(facts)]
    return spark.createDataFrame(rows, COMMANDS)


def read_feed(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A feed of one ``{"type", "payload"}`` object a line: type, payload (VARIANT), and the text of the payload."""
    lines = (spark.readStream if stream else spark.read).text(path)
    line = F.parse_json("value")
    rows = lines.filter(F.trim("value") != "").select(F.variant_get(line, "$.type", "string").alias("type"), F.variant_get(line, "$.payload", "variant").alias("payload"))
    return rows.withColumn("payload_text", F.to_json("payload"))


def write_facts(outcomes: DataFrame, path: str) -> None:
    """Asserted facts as Parquet, for replay by ``read_written``."""
    from ..operators.sessions import export_facts

    export_facts(outcomes).write.mode("overwrite").parquet(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMANDS).parquet(path)
