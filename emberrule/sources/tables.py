"""Fact types over Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lhs import Facts


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Fact type: table, number of a row, session of a row.
TABLES = {
    "Region": ("region", "r_regionkey"),
    "Nation": ("nation", "n_nationkey"),
    "Customer": ("customer", "c_custkey"),
    "Supplier": ("supplier", "s_suppkey"),
    "Part": ("part", "p_partkey"),
    "Order": ("orders", "o_orderkey"),
    "LineItem": ("lineitem", "l_orderkey * 10 + l_linenumber"),
    "Event": ("events", "event_id"),
    "Embedding": ("embeddings", "vec_id"),
}


class TableSources(dict):
    """Fact types on demand, so that a rule opens only the tables it names."""

    def __init__(self, spark: SparkSession, folder: str, sessions: dict[str, str] | None = None, recency: dict[str, str] | None = None):
        super().__init__()
        self.spark, self.folder, self.sessions, self.by_recency = spark, folder, sessions or {}, recency or {}

    def __missing__(self, fact: str) -> Facts:
        table, handle = TABLES[fact]
        rows = parquet(self.spark, self.folder, table)
        if fact == "Event":
            rows = rows.withColumn("props", F.try_parse_json("props"))
        session = F.expr(self.sessions[fact]) if fact in self.sessions else None
        recency = F.expr(self.by_recency[fact]) if fact in self.by_recency else None
        found = self[fact] = Facts(rows, F.expr(handle), recency, session, finite=True)
        return found
