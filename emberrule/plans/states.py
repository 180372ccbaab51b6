"""Registered queries about firing order, final facts, conclusions, retention and explanation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl.reader import load_rules
from ..functions.kernel import Options
from ..functions.kernel import keep_newest as newest_facts
from ..operators.explain import explain_counts
from ..operators.retention import gate_updates, keep_newest, keep_per_type, keep_window
from ..operators.sessions import fact_commands, fire_commands, run_sessions
from ..sources.tables import TableSources, parquet
from .catalog import rule_text
from .lhs import ranked

BIG = rule_text("[{fact: Order, as: o, where: {o_totalprice: {gt: 400000}}}]", "{id: {$ref: o.o_orderkey}}", "big", 10)
OPEN = rule_text("[{fact: Order, as: o, where: {o_orderstatus: {eq: P}}}]", "{id: {$ref: o.o_orderkey}}", "open")
_ORDER = "row_number() over (partition by o_custkey order by salience desc, o_orderkey desc, rule_id)"
_FIRINGS = (
    "select o_custkey::varchar as session_id, rule_id, o_orderkey as id, seq from (select *, "
    + _ORDER
    + " as seq from (select o_custkey, o_orderkey, 10 as salience, 'big' as rule_id from orders where o_totalprice > 400000"
    " union all select o_custkey, o_orderkey, 0, 'open' from orders where o_orderstatus = 'P'))"
)


def fire_order(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    rules = load_rules(("big", BIG), ("open", OPEN)).rules
    df = ranked(list(rules), TableSources(spark, folder, sessions={"Order": "o_custkey"}))
    df = df.filter(F.col("seq") <= most) if most else df
    return df.select("session_id", "rule_id", F.col("handles")[0].alias("id"), "seq")


def runners_up(spark: SparkSession, folder: str) -> DataFrame:
    """The first three of each session's agenda: a top-k report."""
    return fire_order(spark, folder, 3)


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    columns = {"id": "o_orderkey", "customerId": "o_custkey", "status": "o_orderstatus", "total": "o_totalprice"}
    return fact_commands(parquet(spark, folder, "orders"), "o_custkey", "Order", "o_orderkey", columns, 1)


def _facts(outcomes: DataFrame, fact: str, **fields: str) -> DataFrame:
    v = F.parse_json("payload")
    kept = outcomes.filter((F.col("what") == "fact") & (F.col("name") == fact))
    return kept.select(*(F.try_variant_get(v, f"$.{k}", t).alias(k) for k, t in fields.items()))


SET_FIELD = """
apiVersion: rules.v1
rules:
  - id: band
    when: [{fact: Order, as: o, where: {status: {eq: P}, total: {gt: 200000}, band: {hasField: false}}}]
    then: [{action: setField, target: o, field: band, value: {$expr: "o.total > 400000.0 ? 'HIGH' : 'MID'"}}]
"""


def set_field_state(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(run_sessions(_orders(spark, folder), load_rules(("set", SET_FIELD))), "Order", id="long", band="string")


DERIVE = """
apiVersion: rules.v1
rules:
  - id: idle
    salience: 10
    when:
      - {fact: Order, as: o, where: {status: {eq: P}}}
      - {fact: Step, as: s, quantifier: notExists, where: {of: {eq: {$ref: o.id}}}}
    then: [{action: insertFact, fact: Idle, logical: true, payload: {task: {$ref: o.id}, owner: {$ref: o.customerId}}}]
  - id: backlog
    when:
      - {fact: Customer, as: c}
      - {fact: Idle, as: n, quantifier: accumulate, accumulate: {count: true, having: {gte: 2}}, where: {owner: {eq: {$ref: c.id}}}}
    then: [{action: emit, event: backlog.found, payload: {id: {$ref: c.id}, n: {$ref: n}}}]
"""


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return fact_commands(parquet(spark, folder, "customer"), "c_custkey", "Customer", "c_custkey", {"id": "c_custkey", "segment": "c_mktsegment"})


def _emitted(outcomes: DataFrame, **fields: str) -> DataFrame:
    v = F.parse_json("payload")
    return outcomes.filter("what = 'emit'").select(*(F.try_variant_get(v, f"$.{k}", t).alias(k) for k, t in fields.items()))


def derive_chain(spark: SparkSession, folder: str) -> DataFrame:
    out = run_sessions(_customers(spark, folder).unionByName(_orders(spark, folder)), load_rules(("derive", DERIVE)))
    v = F.parse_json("payload")
    return out.filter("what = 'emit'").select(F.variant_get(v, "$.id", "long").alias("id"), F.variant_get(v, "$.n", "long").alias("n"))


RETRACT = """
apiVersion: rules.v1
rules:
  - id: cancel
    when: [{fact: Order, as: o, where: {status: {eq: F}}}]
    then: [{action: retractFact, target: o}]
"""


def retract_state(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(run_sessions(_orders(spark, folder), load_rules(("cancel", RETRACT))), "Order", id="long")


def logical_withdraw(spark: SparkSession, folder: str) -> DataFrame:
    """Conclusions about pending orders, half of which later steps withdraw."""
    orders = parquet(spark, folder, "orders")
    paid = fact_commands(orders.filter("o_orderkey % 2 = 0"), "o_custkey", "Step", "o_orderkey", {"of": "o_orderkey"}, 2)
    commands = _orders(spark, folder).unionByName(fire_commands(orders, "o_custkey", 2)).unionByName(paid)
    return _facts(run_sessions(commands, load_rules(("derive", DERIVE))), "Idle", task="long", owner="long")


def _statistics(spark: SparkSession, folder: str, text: str, options: Options, *names: str) -> DataFrame:
    out = run_sessions(_orders(spark, folder), load_rules(("rules", text)), options).filter("what = 'status'")
    v = F.parse_json("payload")
    return out.select("session_id", F.col("name").alias("status"), *(F.try_variant_get(v, f"$.{n}", "long").alias(n) for n in names))


def session_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _statistics(spark, folder, SET_FIELD, Options(), "inserts", "firings", "updates", "facts")


def session_limit(spark: SparkSession, folder: str) -> DataFrame:
    """No session fires more than twice."""
    return _statistics(spark, folder, SET_FIELD, Options(max_cycles=2), "firings")


def evict_at_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Each insert leaves a session its three newest facts."""
    return _statistics(spark, folder, SET_FIELD, Options(evict=(newest_facts(3),)), "inserts", "evicted", "facts")


FAILING = """
apiVersion: rules.v1
rules:
  - id: share
    when: [{fact: Order, as: o}]
    then: [{action: emit, event: share, payload: {id: {$ref: o.id}, x: {$expr: '1000 / (o.id % 3)'}}}]
"""


def skip_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Firings that fail are skipped; the others go on."""
    out = run_sessions(_orders(spark, folder), load_rules(("failing", FAILING)), Options(on_error="SKIP_ACTIVATION"))
    return _emitted(out, id="long", x="long")


def abort_failures(spark: SparkSession, folder: str) -> DataFrame:
    """A session ends with its first failure."""
    return _statistics(spark, folder, FAILING, Options(on_error="ABORT_SESSION"), "inserts")


def effects_log(spark: SparkSession, folder: str) -> DataFrame:
    """What each firing wrote, in the order of the session."""
    out = run_sessions(_orders(spark, folder), load_rules(("set", SET_FIELD))).filter("what = 'set'")
    return out.select("session_id", "seq", F.col("rule_id"), F.col("handles")[0].alias("handle"), "payload")


def evict_lru(spark: SparkSession, folder: str) -> DataFrame:
    return keep_newest(parquet(spark, folder, "events"), 5, ["user_id"], [F.col("event_id")]).select("user_id", "event_id")


def evict_per_type(spark: SparkSession, folder: str) -> DataFrame:
    return keep_per_type(parquet(spark, folder, "events"), {"click": 2, "view": 3}, ["user_id"], "event_type", [F.col("event_id")]).select("user_id", "event_id", "event_type")


def evict_window(spark: SparkSession, folder: str) -> DataFrame:
    return keep_window(parquet(spark, folder, "events"), F.col("ts"), F.expr("interval 1 day"), ["user_id"]).select("user_id", "event_id")


def flatten_items(spark: SparkSession, folder: str) -> DataFrame:
    """One fact for each element of a list."""
    rows = parquet(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


def update_gate(spark: SparkSession, folder: str) -> DataFrame:
    old = parquet(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    price = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    priority = F.when(F.col("o_orderkey") % 2 == 0, F.lit("CHANGED")).otherwise(F.col("o_orderpriority"))
    new = old.withColumns({"o_totalprice": price, "o_orderpriority": priority})
    return gate_updates(old, new, "o_orderkey", ["o_totalprice"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def explain_query(spark: SparkSession, folder: str) -> DataFrame:
    text = rule_text("[{fact: Order, as: o, where: {o_orderstatus: {eq: P}, o_totalprice: {gt: 400000}}}, {fact: Customer, as: c, where: {c_custkey: {eq: {$ref: o.o_custkey}}, c_mktsegment: {in: [BUILDING, MACHINERY]}}}]", "{id: {$ref: o.o_orderkey}}")
    return explain_counts(load_rules(("r", text)).rules[0], TableSources(spark, folder)).drop("worst")


QUERIES = {
    "fire_order": fire_order,
    "runners_up": runners_up,
    "set_field_state": set_field_state,
    "derive_chain": derive_chain,
    "retract_state": retract_state,
    "logical_withdraw": logical_withdraw,
    "session_stats": session_stats,
    "session_limit": session_limit,
    "evict_at_insert": evict_at_insert,
    "skip_failures": skip_failures,
    "abort_failures": abort_failures,
    "effects_log": effects_log,
    "evict_lru": evict_lru,
    "evict_per_type": evict_per_type,
    "evict_window": evict_window,
    "flatten_items": flatten_items,
    "update_gate": update_gate,
    "explain_counts": explain_query,
}

_SET = "o_orderstatus = 'P' and o_totalprice > 200000"
_BY_SESSION = "from orders group by o_custkey"

ORACLE_SQL = {
    "session_stats": f"select o_custkey::varchar as session_id, 'DRAINED' as status, count(*) as inserts, count(*) filter ({_SET}) as firings, count(*) filter ({_SET}) as updates, count(*) as facts {_BY_SESSION}",
    "session_limit": f"select o_custkey::varchar as session_id, case when count(*) filter ({_SET}) > 2 then 'LIMIT_EXCEEDED' else 'DRAINED' end as status, least(2, count(*) filter ({_SET})) as firings {_BY_SESSION}",
    "evict_at_insert": f"select o_custkey::varchar as session_id, 'DRAINED' as status, count(*) as inserts, greatest(0, count(*) - 3) as evicted, least(3, count(*)) as facts {_BY_SESSION}",
    "skip_failures": "select o_orderkey as id, 1000 // (o_orderkey % 3) as x from orders where o_orderkey % 3 <> 0",
    "abort_failures": f"select o_custkey::varchar as session_id, case when bool_or(o_orderkey % 3 = 0) then 'RHS_ERROR' else 'DRAINED' end as status, count(*) as inserts {_BY_SESSION}",
    "effects_log": "select o_custkey::varchar as session_id, row_number() over (partition by o_custkey order by o_orderkey desc) - 1 as seq, 'band' as rule_id, handle, case when o_totalprice > 400000 then '\"HIGH\"' else '\"MID\"' end as payload "
    f"from (select *, row_number() over (partition by o_custkey order by o_orderkey) - 1 as handle from orders) where {_SET}",
    "fire_order": _FIRINGS,
    "runners_up": f"select * from ({_FIRINGS}) where seq <= 3",
    "set_field_state": "select o_orderkey as id, case when o_orderstatus = 'P' and o_totalprice > 400000 then 'HIGH' when o_orderstatus = 'P' and o_totalprice > 200000 then 'MID' end as band from orders",
    "derive_chain": "select o_custkey as id, count(*) as n from orders where o_orderstatus = 'P' group by o_custkey having count(*) >= 2",
    "retract_state": "select o_orderkey as id from orders where o_orderstatus <> 'F'",
    "logical_withdraw": 'select o_orderkey as task, o_custkey as owner from orders where o_orderstatus = \'P\' and o_orderkey % 2 <> 0',
    "evict_lru": "select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id desc) <= 5",
    "evict_per_type": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id, event_type order by event_id desc) <= case event_type when 'click' then 2 when 'view' then 3 else 1000000000 end",
    "evict_window": "select user_id, event_id from events qualify ts >= max(ts) over (partition by user_id) - interval 1 day",
    "flatten_items": "select vec_id, (u.pos - 1)::bigint as pos, u.x::double as x from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings) u",
    "update_gate": "select case when o_orderkey % 3 = 0 then 'propagated' when o_orderkey % 2 = 0 then 'stored' else 'unchanged' end as outcome, count(*) as n from orders group by 1",
    "explain_counts": "select 'o' as alias, count(*) as considered, count(*) filter (o_orderstatus = 'P' and o_totalprice > 400000) as survivors, greatest(count(*) filter (o_orderstatus <> 'P'), count(*) filter (o_orderstatus = 'P' and not o_totalprice > 400000)) as eliminated from orders union all select 'c', count(*), count(*) filter (c_mktsegment in ('BUILDING', 'MACHINERY')), count(*) filter (c_mktsegment not in ('BUILDING', 'MACHINERY')) from customer",
}
