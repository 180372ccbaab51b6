"""Registered rules over the standard tables, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..dsl.builder import RuleBuilder, Where, ref
from ..dsl.compiler import compile_rules
from ..dsl.reader import load_rules
from ..sources.tables import TableSources
from .lhs import emitted

#: name: (patterns of the rule, payload of its event, SQL)
RULES: dict[str, tuple[str, str, str]] = {}


def _rule(name: str, when: str, payload: str, sql: str) -> None:
    RULES[name] = (when, payload, sql)


_O = "{id: {$ref: o.o_orderkey}}"
_rule("scan_emit", "[{fact: Nation, as: n}]", "{id: {$ref: n.n_nationkey}, name: {$ref: n.n_name}}", "select n_nationkey as id, n_name as name from nation")
for _op, _sql in (("eq", "="), ("ne", "is distinct from")):
    _rule(f"alpha_{_op}", f"[{{fact: Order, as: o, where: {{o_orderstatus: {{{_op}: P}}}}}}]", _O, f"select o_orderkey as id from orders where o_orderstatus {_sql} 'P'")
for _op, _sql in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _rule(f"alpha_{_op}", f"[{{fact: Order, as: o, where: {{o_totalprice: {{{_op}: 250000}}}}}}]", _O, f"select o_orderkey as id from orders where o_totalprice {_sql} 250000")
_rule("alpha_between_half_open", "[{fact: LineItem, as: l, where: {l_quantity: {between: {from: 10, to: 20, toInclusive: false}}}}]",
      "{id: {$ref: l.l_orderkey}, line: {$ref: l.l_linenumber}}", "select l_orderkey as id, l_linenumber as line from lineitem where l_quantity >= 10 and l_quantity < 20")
for _op, _sql in (("in", "in"), ("notIn", "not in")):
    _rule(f"alpha_{'in' if _op == 'in' else 'not_in'}", f"[{{fact: Customer, as: c, where: {{c_mktsegment: {{{_op}: [BUILDING, MACHINERY]}}}}}}]",
          "{id: {$ref: c.c_custkey}}", f"select c_custkey as id from customer where c_mktsegment {_sql} ('BUILDING', 'MACHINERY')")
_rule("alpha_matches", "[{fact: Part, as: p, where: {p_brand: {matches: '^Brand#1'}}}]", "{id: {$ref: p.p_partkey}}", "select p_partkey as id from part where regexp_matches(p_brand, '^Brand#1')")
_rule("alpha_has_field", "[{fact: Event, as: e, where: {props.k: {hasField: true}, props.zz: {hasField: false}}}]", "{id: {$ref: e.event_id}}",
      "select event_id as id from events where json_exists(props, '$.k') and not json_exists(props, '$.zz')")
_rule("alpha_is_null", "[{fact: Event, as: e, where: {props.zz: {isNull: false}, props.k: {isNull: false, ne: null}}}]", "{id: {$ref: e.event_id}}",
      "select event_id as id from events where json_type(props, '$.k') is distinct from 'NULL'")
_rule("alpha_variant_range", "[{fact: Event, as: e, where: {props.k: {gte: 50, lt: 70}}}]", "{id: {$ref: e.event_id}}",
      "select event_id as id from events where (props->>'$.k')::double >= 50 and (props->>'$.k')::double < 70")
_rule("join_equi", "[{fact: Order, as: o, where: {o_orderstatus: {eq: P}, o_totalprice: {gt: 400000}}}, {fact: Customer, as: c, where: {c_custkey: {eq: {$ref: o.o_custkey}}, c_mktsegment: {in: [BUILDING, MACHINERY]}}}]",
      "{orderId: {$ref: o.o_orderkey}, customerId: {$ref: c.c_custkey}, segment: {$ref: c.c_mktsegment}}",
      "select o_orderkey as \"orderId\", c_custkey as \"customerId\", c_mktsegment as segment from orders join customer on c_custkey = o_custkey where o_orderstatus = 'P' and o_totalprice > 400000 and c_mktsegment in ('BUILDING', 'MACHINERY')")
_rule("join_range", "[{fact: Part, as: a}, {fact: Part, as: b, where: {p_brand: {eq: {$ref: a.p_brand}}, p_retailprice: {lt: {$ref: a.p_retailprice}}}}]",
      "{a: {$ref: a.p_partkey}, b: {$ref: b.p_partkey}}", "select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_brand = b.p_brand and b.p_retailprice < a.p_retailprice and a.p_partkey <> b.p_partkey")
_rule("join_not_equal", "[{fact: Supplier, as: s}, {fact: Customer, as: c, where: {c_nationkey: {eq: {$ref: s.s_nationkey}}, c_acctbal: {ne: {$ref: s.s_acctbal}}}}]",
      "{s: {$ref: s.s_suppkey}, c: {$ref: c.c_custkey}}", "select s_suppkey as s, c_custkey as c from supplier join customer on c_nationkey = s_nationkey and c_acctbal is distinct from s_acctbal")
_rule("join_between_refs", "[{fact: Supplier, as: a}, {fact: Supplier, as: b, where: {s_nationkey: {eq: {$ref: a.s_nationkey}}}}, {fact: Customer, as: c, where: {c_nationkey: {eq: {$ref: a.s_nationkey}}, c_acctbal: {between: {from: {$ref: a.s_acctbal}, to: {$ref: b.s_acctbal}}}}}]",
      "{a: {$ref: a.s_suppkey}, b: {$ref: b.s_suppkey}, c: {$ref: c.c_custkey}}",
      "select a.s_suppkey as a, b.s_suppkey as b, c_custkey as c from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey join customer on c_nationkey = a.s_nationkey and c_acctbal between a.s_acctbal and b.s_acctbal")
_rule("join_self_distinct", "[{fact: Order, as: a}, {fact: Order, as: b, where: {o_custkey: {eq: {$ref: a.o_custkey}}}}]",
      "{a: {$ref: a.o_orderkey}, b: {$ref: b.o_orderkey}}", "select a.o_orderkey as a, b.o_orderkey as b from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey <> b.o_orderkey")
_rule("join_three_way", "[{fact: Region, as: r, where: {r_name: {eq: EUROPE}}}, {fact: Nation, as: n, where: {n_regionkey: {eq: {$ref: r.r_regionkey}}}}, {fact: Customer, as: c, where: {c_nationkey: {eq: {$ref: n.n_nationkey}}}}]",
      "{region: {$ref: r.r_name}, nation: {$ref: n.n_name}, c: {$ref: c.c_custkey}}",
      "select r_name as region, n_name as nation, c_custkey as c from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey where r_name = 'EUROPE'")
_rule("join_cross", "[{fact: Region, as: r}, {fact: Nation, as: n}]", "{r: {$ref: r.r_regionkey}, n: {$ref: n.n_nationkey}}", "select r_regionkey as r, n_nationkey as n from region, nation")
for _op, _sql in (("after", "c.ts < p.ts and p.ts <= c.ts + interval 1 hour"), ("before", "c.ts - interval 1 hour <= p.ts and p.ts < c.ts")):
    _rule(f"temporal_{_op}", f"[{{fact: Event, as: c, where: {{event_type: {{eq: click}}}}}}, {{fact: Event, as: p, where: {{event_type: {{eq: purchase}}, user_id: {{eq: {{$ref: c.user_id}}}}, ts: {{{_op}: {{$ref: c.ts, within: 3600}}}}}}}}]",
          "{c: {$ref: c.event_id}, p: {$ref: p.event_id}}", f"select c.event_id as c, p.event_id as p from events c join events p on c.user_id = p.user_id where c.event_type = 'click' and p.event_type = 'purchase' and {_sql}")
_C = "{id: {$ref: c.c_custkey}}"
_rule("not_exists", "[{fact: Customer, as: c}, {fact: Order, as: o, quantifier: notExists, where: {o_custkey: {eq: {$ref: c.c_custkey}}, o_orderstatus: {eq: P}}}]", _C,
      "select c_custkey as id from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
_rule("not_exists_other", "[{fact: Order, as: o}, {fact: Order, as: x, quantifier: notExists, where: {o_custkey: {eq: {$ref: o.o_custkey}}, o_orderdate: {gt: {$ref: o.o_orderdate}}}}]", _O,
      "select o_orderkey as id from orders o where not exists (select 1 from orders x where x.o_custkey = o.o_custkey and x.o_orderkey <> o.o_orderkey and x.o_orderdate > o.o_orderdate)")
_ALL = "{fact: LineItem, as: l, quantifier: forAll, where: {l_orderkey: {eq: {$ref: o.o_orderkey}}, l_linestatus: {eq: O}, l_quantity: {gt: 0}}}"
_ALL_SQL = "not exists (select 1 from lineitem where l_orderkey = o_orderkey and not coalesce(l_linestatus = 'O' and l_quantity > 0, false))"
_rule("for_all", f"[{{fact: Order, as: o}}, {_ALL}]", _O, f"select o_orderkey as id from orders where {_ALL_SQL}")
_rule("for_all_nonempty", f"[{{fact: Order, as: o}}, {_ALL}, {{fact: LineItem, as: n, quantifier: accumulate, accumulate: {{count: true, having: {{gte: 1}}}}, where: {{l_orderkey: {{eq: {{$ref: o.o_orderkey}}}}}}}}]", _O,
      f"select o_orderkey as id from orders where {_ALL_SQL} and exists (select 1 from lineitem where l_orderkey = o_orderkey)")
_rule("for_all_global", "[{fact: Nation, as: n}, {fact: LineItem, as: l, quantifier: forAll, where: {l_quantity: {gt: 0}}}]", "{id: {$ref: n.n_nationkey}}",
      "select n_nationkey as id from nation where not exists (select 1 from lineitem where not coalesce(l_quantity > 0, false))")


def _fold(name: str, block: str, answer: str, having: str = "") -> None:
    _rule(name, f"[{{fact: Order, as: o}}, {{fact: LineItem, as: x, quantifier: accumulate, accumulate: {{{block}}}, where: {{l_orderkey: {{eq: {{$ref: o.o_orderkey}}}}}}}}]",
          "{id: {$ref: o.o_orderkey}, x: {$ref: x}}", f"select o_orderkey as id, {answer} as x from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey {having}")


_fold("acc_count", "count: true", "count(l_orderkey)")
_fold("acc_sum", "sum: l_quantity", "coalesce(sum(l_quantity), 0)")
_fold("acc_average", "average: l_quantity", "sum(l_quantity) / count(l_quantity)")
_fold("acc_min", "min: l_extendedprice", "min(l_extendedprice)")
_fold("acc_max", "max: l_extendedprice", "max(l_extendedprice)")
_fold("acc_having", "sum: l_quantity, having: {gte: 100}", "sum(l_quantity)", "having sum(l_quantity) >= 100")
_rule("acc_others", "[{fact: Order, as: o}, {fact: Order, as: n, quantifier: accumulate, accumulate: {count: true}, where: {o_custkey: {eq: {$ref: o.o_custkey}}}}]",
      "{id: {$ref: o.o_orderkey}, n: {$ref: n}}", "select o_orderkey as id, count(*) over (partition by o_custkey) - 1 as n from orders")
_rule("acc_vs_field", "[{fact: Customer, as: c, condition: 'total > c.c_acctbal * 100.0'}, {fact: Order, as: total, quantifier: accumulate, accumulate: {max: o_totalprice, having: {gt: 0}}, where: {o_custkey: {eq: {$ref: c.c_custkey}}}}]",
      "{id: {$ref: c.c_custkey}, total: {$ref: total}}", "select c_custkey as id, max(o_totalprice) as total from customer join orders on o_custkey = c_custkey group by c_custkey, c_acctbal having max(o_totalprice) > c_acctbal * 100")
_rule("velocity", "[{fact: Event, as: e, where: {event_type: {eq: error}}}, {fact: Event, as: n, quantifier: accumulate, accumulate: {count: true, having: {gte: 2}}, where: {event_type: {eq: error}, user_id: {eq: {$ref: e.user_id}}, ts: {before: {$ref: e.ts, within: 86400}}}}]",
      "{id: {$ref: e.event_id}, n: {$ref: n}}",
      "select e.event_id as id, count(*) as n from events e join events x on x.user_id = e.user_id and x.event_id <> e.event_id and e.ts - interval 1 day <= x.ts and x.ts < e.ts where e.event_type = 'error' and x.event_type = 'error' group by e.event_id having count(*) >= 2")
_rule("cond_or", "[{fact: LineItem, as: l, condition: 'l.l_extendedprice * (1.0 - l.l_discount) > 50000.0 && (l.l_returnflag == \"R\" || !(l.l_linestatus == \"O\"))'}]",
      "{id: {$ref: l.l_orderkey}, line: {$ref: l.l_linenumber}}", "select l_orderkey as id, l_linenumber as line from lineitem where l_extendedprice * (1.0::double - l_discount) > 50000 and (l_returnflag = 'R' or not l_linestatus = 'O')")
_rule("value_expr", "[{fact: Order, as: o, where: {o_orderstatus: {eq: P}}}]", "{id: {$ref: o.o_orderkey}, band: {$expr: 'o.o_totalprice > 400000.0 ? \"HIGH\" : o.o_totalprice > 200000.0 ? \"MID\" : \"LOW\"'}}",
      "select o_orderkey as id, case when o_totalprice > 400000 then 'HIGH' when o_totalprice > 200000 then 'MID' else 'LOW' end as band from orders where o_orderstatus = 'P'")


for _f in ("sum", "average"):
    _rule(f"acc_variant_{_f}", f"[{{fact: Customer, as: c}}, {{fact: Event, as: x, quantifier: accumulate, accumulate: {{{_f}: props.k}}, where: {{user_id: {{eq: {{$ref: c.c_custkey}}}}}}}}]",
          "{id: {$ref: c.c_custkey}, x: {$ref: x}}", f"select c_custkey as id, {'coalesce(sum((props->>\'$.k\')::double), 0)' if _f == 'sum' else 'avg((props->>\'$.k\')::double)'} as x from customer left join events on user_id = c_custkey group by c_custkey")
for _f in ("min", "max"):
    _rule(f"acc_variant_{_f}", f"[{{fact: Customer, as: c}}, {{fact: Event, as: x, quantifier: accumulate, accumulate: {{{_f}: props.k, having: {{gte: 5}}}}, where: {{user_id: {{eq: {{$ref: c.c_custkey}}}}}}}}]",
          "{id: {$ref: c.c_custkey}, x: {$expr: 'double(x)'}}", f"select c_custkey as id, {_f}((props->>'$.k')::double) as x from customer join events on user_id = c_custkey group by c_custkey having {_f}((props->>'$.k')::double) >= 5")
_EV = "{id: {$ref: e.event_id}}"
_rule("cond_variant", "[{fact: Event, as: e, condition: 'e.props.k % 2 == 1 && e.props.k + 1 > 50'}]", _EV, "select event_id as id from events where (props->>'$.k')::bigint % 2 = 1 and (props->>'$.k')::bigint + 1 > 50")
_rule("cond_has", "[{fact: Event, as: e, condition: '(has(e.props.zz) && e.props.zz > 1) || (has(e.props.k) && e.props.k > 90)'}]", _EV,
      "select event_id as id from events where (json_exists(props, '$.zz') and (props->>'$.zz')::double > 1) or (json_exists(props, '$.k') and (props->>'$.k')::double > 90)")
_rule("cond_absorbs", "[{fact: Event, as: e, condition: 'e.event_type == \"click\" ? true : e.props.zz > 1 || e.user_id >= 0'}]", _EV, "select event_id as id from events")
_rule("expr_division", "[{fact: LineItem, as: l, condition: 'l.l_orderkey / l.l_linenumber % 2 == 1'}]", "{id: {$ref: l.l_orderkey}, line: {$ref: l.l_linenumber}, q: {$expr: '-l.l_orderkey / l.l_linenumber'}}",
      "select l_orderkey as id, l_linenumber as line, -(l_orderkey // l_linenumber)::bigint as q from lineitem where l_orderkey // l_linenumber % 2 = 1")
_rule("expr_macros", "[{fact: Embedding, as: v, condition: 'v.embedding.exists(x, x > 0.3) && !v.embedding.all(x, x < 0.35)'}]", "{id: {$ref: v.vec_id}, n: {$expr: 'size(v.embedding.filter(x, x < 0.0))'}}",
      "select vec_id as id, len(list_filter(embedding, lambda x: x < 0))::bigint as n from embeddings where len(list_filter(embedding, lambda x: x::double > 0.3)) > 0 and len(list_filter(embedding, lambda x: not x::double < 0.35)) > 0")
_rule("expr_size", "[{fact: Part, as: p, condition: 'size(p.p_brand) > 7 && p.p_brand.startsWith(\"Brand\")'}]", "{id: {$ref: p.p_partkey}, n: {$expr: 'size(p.p_name)'}}",
      "select p_partkey as id, length(p_name) as n from part where length(p_brand) > 7 and starts_with(p_brand, 'Brand')")
_rule("expr_times", "[{fact: Event, as: e, condition: 'e.ts.getHours() == 3 && e.ts < timestamp(\"2024-01-15T00:00:00Z\")'}]", "{id: {$ref: e.event_id}, minute: {$expr: 'e.ts.getMinutes()'}, day: {$expr: 'e.ts.getDayOfYear()'}}",
      "select event_id as id, minute(ts) as minute, dayofyear(ts) - 1 as day from events where hour(ts) = 3 and ts < timestamp '2024-01-15'")


def rule_text(when: str, payload: str, rule_id: str = "r", salience: int = 0) -> str:
    return f"apiVersion: rules.v1\nrules:\n  - id: {rule_id}\n    salience: {salience}\n    when: {when}\n    then: [{{action: emit, event: found, payload: {payload}}}]\n"


def _query(name: str, when: str, payload: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rules = load_rules((name, rule_text(when, payload)))
        return emitted(rules.rules[0], TableSources(spark, folder))

    run.__name__ = name
    return run


def join_membership(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a label whose first number an earlier one holds: only built rules say so, rule files can't."""
    where = Where().eq("label", ref("a.label")).gt("vec_id", ref("a.vec_id")).is_in("embedding.0", ref("a.embedding"))
    rule = RuleBuilder("member").when("Embedding", "a").when("Embedding", "b", where).emit("found", a=ref("a.vec_id"), b=ref("b.vec_id"))
    return emitted(compile_rules([rule.build()]).rules[0], TableSources(spark, folder))


QUERIES = {name: _query(name, when, payload) for name, (when, payload, _) in RULES.items()} | {"join_membership": join_membership}
ORACLE_SQL = {name: sql for name, (_, _, sql) in RULES.items()} | {
    "join_membership": "select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.label = b.label and b.vec_id > a.vec_id and list_contains(a.embedding, b.embedding[1])"
}
