"""Expressions as Spark columns, with the answers and errors that ``evaluate`` gives over JSON values.

A value is a set of columns, one for each class that it can have, each null in rows where it isn't of that class. Where all
are null and the value isn't an explicit null, it is an error. So a boolean that is null is an error, and SQL's and and
or treat errors as the language wants: the other side decides if it can.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expressions import MACROS, ExpressionError, Node, chain

VARIANT_KINDS = (("int", "BIGINT|INT|SMALLINT|TINYINT", "bigint"), ("double", "DOUBLE|FLOAT|DECIMAL.*", "double"), ("string", "STRING", "string"), ("boolean", "BOOLEAN", "boolean"), ("array", "ARRAY.*", "array<variant>"))
TYPES: dict[str, T.DataType] = {"int": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "time": T.TimestampType()}


@dataclass(frozen=True)
class Val:
    parts: dict[str, Column] = field(default_factory=dict)
    null: Column | None = None  # where the value is an explicit null; None: nowhere
    element: T.DataType | None = None  # of the array
    object: T.StructType | None = None

    def get(self, kind: str) -> Column:
        return self.parts.get(kind, F.lit(None).cast(TYPES.get(kind, T.StringType())))

    def error(self) -> Column:
        if not self.parts:
            return F.lit(True) if self.null is None else ~self.null
        none = reduce(lambda a, b: a & b, [p.isNull() for p in self.parts.values()])
        return none if self.null is None else none & ~self.null


class Scope(Protocol):
    def value(self, alias: str, path: str) -> Val: ...

    def present(self, alias: str, path: str) -> Column: ...


def typed(c: Column, t: T.DataType, nullable: bool = True) -> Val:
    """A column of a known type; null is explicit null if ``nullable``, else an error."""
    null = c.isNull() if nullable else None
    if isinstance(t, T.VariantType):
        return variant(c)
    if isinstance(t, T.StringType):
        return Val({"string": c}, null)
    if isinstance(t, T.BooleanType):
        return Val({"boolean": c}, null)
    if isinstance(t, (T.DoubleType, T.FloatType)) or (isinstance(t, T.DecimalType) and t.scale):
        return Val({"double": c.cast("double")}, null)
    if isinstance(t, T.NumericType):
        return Val({"int": c.cast("long")}, null)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Val({"time": c.cast("timestamp")}, null)
    if isinstance(t, T.ArrayType):
        return Val({"array": c}, null, t.elementType)
    if isinstance(t, T.StructType):
        return Val({"object": c}, null, object=t)
    return Val({}, null)


def variant(c: Column) -> Val:
    schema = F.schema_of_variant(c)
    parts = {k: F.when(schema.rlike(f"^({names})$"), F.try_variant_get(c, "$", target)) for k, names, target in VARIANT_KINDS}
    return Val(parts, F.coalesce(F.is_variant_null(c), F.lit(False)), T.VariantType())


def literal(v: Any) -> Val:
    if v is None:
        return Val({}, F.lit(True))
    return Val({{bool: "boolean", int: "int", float: "double", str: "string"}[type(v)]: F.lit(v).cast("long") if type(v) is int else F.lit(v)})


def _one_type(kinds: list[str]) -> str | None:
    return kinds[0] if len(set(kinds)) == 1 else None


def emit(node: Node, scope: Scope) -> Val:
    """The value of an expression in each row."""
    link = chain(node)
    if link:
        return scope.value(*link)
    op, a = node.op, node.args
    if op == "lit":
        return literal(a[0])
    if op == "list":
        items = [emit(x, scope) for x in a]
        kind = _one_type([k for v in items for k in v.parts])
        if kind not in TYPES or any(len(v.parts) != 1 for v in items):
            raise ExpressionError("a list in a plan holds values of one type")
        wrong = reduce(lambda p, q: p | q, [v.error() for v in items])
        return Val({"array": F.when(~wrong, F.array(*(v.parts[kind] for v in items)))}, None, TYPES[kind])
    if op == "get" or (op == "index" and a[1].op == "lit" and isinstance(a[1].args[0], str)):
        return _field(emit(a[0], scope), a[1] if op == "get" else a[1].args[0])
    if op == "index":
        owner, at = emit(a[0], scope), emit(a[1], scope).get("int")
        items = owner.get("array")
        if owner.element is None:
            return Val()
        v = typed(F.get(items, at.cast("int")), owner.element)
        inside = (at >= 0) & (at < F.size(items))
        return Val({k: F.when(inside, p) for k, p in v.parts.items()}, F.coalesce(inside & v.null, F.lit(False)) if v.null is not None else None, v.element, v.object)
    if op == "?:":
        ask, yes, no = (emit(x, scope) for x in a)
        c = ask.get("boolean")
        pick = lambda x, y: F.when(c, x).when(~c, y)
        parts = {k: pick(yes.get(k), no.get(k)) for k in yes.parts | no.parts}
        nulls = [F.lit(False) if v.null is None else v.null for v in (yes, no)]
        both_none = yes.null is None and no.null is None
        return Val(parts, None if both_none else F.coalesce(pick(*nulls), F.lit(False)), yes.element or no.element, yes.object or no.object)
    if op == "not":
        return Val({"boolean": ~emit(a[0], scope).get("boolean")})
    if op == "neg":
        v = emit(a[0], scope)
        return Val({k: -v.parts[k] for k in ("int", "double") if k in v.parts})
    if op == "call":
        return _call(a[0], a[1], a[2], scope)
    x, y = emit(a[0], scope), emit(a[1], scope)
    if op in ("&&", "||"):
        p, q = x.get("boolean"), y.get("boolean")
        return Val({"boolean": p & q if op == "&&" else p | q})
    if op == "in":
        if y.element is None:
            return Val()
        element = y.element
        found = F.exists(y.get("array"), lambda e: F.coalesce(_equal(x, typed(e, element)), F.lit(False)))
        return Val({"boolean": F.when(~x.error(), found)})
    if op in ("==", "!="):
        same = _equal(x, y)
        return Val({"boolean": F.when(~x.error() & ~y.error(), same if op == "==" else ~same)})
    if op in ("<", "<=", ">", ">="):
        return Val({"boolean": _compare(op, x, y)})
    return _arithmetic(op, x, y)


def _pairs(x: Val, y: Val) -> list[tuple[Column, Column]]:
    """Columns of either that can be compared; a whole number with a fractional one as decimals where both may be either."""
    out = [(x.parts[k], y.parts[k]) for k in ("int", "double", "string", "boolean", "time") if k in x.parts and k in y.parts]
    for p, q in (("int", "double"), ("double", "int")):
        if p in x.parts and q in y.parts:
            out.append((x.parts[p], y.parts[q]))
    return out


def _equal(x: Val, y: Val) -> Column:
    same = [F.coalesce(p == q, F.lit(False)) for p, q in _pairs(x, y)]
    if "array" in x.parts and "array" in y.parts and x.element == y.element and not isinstance(x.element, T.VariantType):
        same.append(F.coalesce(x.parts["array"] == y.parts["array"], F.lit(False)))
    if x.null is not None and y.null is not None:
        same.append(x.null & y.null)
    return reduce(lambda p, q: p | q, same, F.lit(False)) if same else F.lit(False)


def _compare(op: str, x: Val, y: Val) -> Column:
    tests = [{"<": p < q, "<=": p <= q, ">": p > q, ">=": p >= q}[op] for p, q in _pairs(Val({k: v for k, v in x.parts.items() if k != "boolean"}), y)]
    return F.coalesce(*tests) if tests else F.lit(None).cast("boolean")


def _arithmetic(op: str, x: Val, y: Val) -> Val:
    parts: dict[str, Column] = {}
    if "int" in x.parts and "int" in y.parts:
        p, q = x.parts["int"], y.parts["int"]
        parts["int"] = {"+": lambda: p + q, "-": lambda: p - q, "*": lambda: p * q, "/": lambda: F.when(q != 0, F.call_function("div", p, F.when(q != 0, q))), "%": lambda: F.when(q != 0, p % F.when(q != 0, q))}[op]()
    if "double" in x.parts and "double" in y.parts:
        p, q = x.parts["double"], y.parts["double"]
        nan, inf = F.lit(float("nan")), F.lit(float("inf"))
        zero = F.when(p > 0, inf).when(p < 0, -inf).when(p.isNotNull(), nan)
        if op != "%" or len(parts) == 0:
            parts["double"] = {"+": lambda: p + q, "-": lambda: p - q, "*": lambda: p * q, "/": lambda: F.when(q == 0, zero).otherwise(F.try_divide(p, q)), "%": lambda: F.when(q != 0, p % F.when(q != 0, q))}[op]()
    if op == "+" and "string" in x.parts and "string" in y.parts:
        parts["string"] = F.concat(x.parts["string"], y.parts["string"])
    element = None
    if op == "+" and "array" in x.parts and "array" in y.parts and x.element == y.element:
        parts["array"], element = F.concat(x.parts["array"], y.parts["array"]), x.element
    return Val(parts, None, element)


def _field(owner: Val, name: str) -> Val:
    if owner.object is not None and name in owner.object.names:
        held = owner.parts["object"]
        v = typed(held.getField(name), owner.object[name].dataType)
        return replace(v, null=None if v.null is None else v.null & held.isNotNull())
    return Val()


@dataclass(frozen=True)
class _Inner:
    """A scope with a macro's variable."""

    name: str
    item: Val
    outer: Scope

    def value(self, alias: str, path: str) -> Val:
        if alias != self.name:
            return self.outer.value(alias, path)
        return reduce(_field, path.split("."), self.item) if path else self.item

    def present(self, alias: str, path: str) -> Column:
        return self.outer.present(alias, path) if alias != self.name else ~self.value(alias, path).error()


def _macro(name: str, target: Val, variable: str, body: Node, scope: Scope) -> Val:
    if target.element is None:
        return Val()
    element, items = target.element, target.get("array")
    ask = lambda e: emit(body, _Inner(variable, typed(e, element), scope))
    yes = lambda e: ask(e).get("boolean")
    if name == "all":
        return Val({"boolean": F.forall(items, yes)})
    if name == "exists":
        return Val({"boolean": F.exists(items, yes)})
    whole = ~F.exists(items, lambda e: ask(e).error())
    if name == "exists_one":
        return Val({"boolean": F.when(whole, F.size(F.filter(items, yes)) == 1)})
    if name == "filter":
        return Val({"array": F.when(whole, F.filter(items, yes))}, None, element)
    kinds: list[str] = []

    def made(e: Column) -> Column:
        v = ask(e)
        kinds[:] = list(v.parts)
        return next(iter(v.parts.values()))

    out = F.transform(items, made)
    if len(kinds) != 1 or kinds[0] not in TYPES:
        raise ExpressionError("'map' in a plan makes values of one type")
    return Val({"array": F.when(whole, out)}, None, TYPES[kinds[0]])


# The names of the public language's time getters, and what they start counting from.
GETTERS: dict[str, Callable[[Column], Column]] = {
    "getFullYear": F.year, "getMonth": lambda t: F.month(t) - 1, "getDate": F.dayofmonth, "getDayOfMonth": lambda t: F.dayofmonth(t) - 1, "getDayOfWeek": lambda t: F.dayofweek(t) - 1,
    "getDayOfYear": lambda t: F.dayofyear(t) - 1, "getHours": F.hour, "getMinutes": F.minute, "getSeconds": F.second, "getMilliseconds": lambda t: F.pmod(F.unix_millis(t), F.lit(1000)),
}


def _call(name: str, target: Node | None, args: tuple[Node, ...], scope: Scope) -> Val:
    if name == "has" and target is None:
        link = chain(args[0])
        return Val({"boolean": scope.present(*link)}) if link else Val({"boolean": ~emit(args[0], scope).error()})
    if name in MACROS and target is not None:
        return _macro(name, emit(target, scope), args[0].args[0], args[1], scope)
    v = [emit(x, scope) for x in ((target, *args) if target is not None else args)]
    x = v[0]
    if name in GETTERS and len(v) == 1:
        return Val({"int": GETTERS[name](x.get("time")).cast("long")})
    if name == "size":
        sizes = [F.length(c) if k == "string" else F.when(c.isNotNull(), F.size(c)) for k, c in x.parts.items() if k in ("string", "array")]
        return Val({"int": F.coalesce(*sizes).cast("long")} if sizes else {})
    if name in ("contains", "startsWith", "endsWith", "matches"):
        ask = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith, "matches": F.regexp_like}[name]
        return Val({"boolean": ask(x.get("string"), v[1].get("string"))})
    if name == "abs":
        return Val({k: F.abs(x.parts[k]) for k in ("int", "double") if k in x.parts})
    text = x.get("string")
    if name in ("int", "uint"):
        made = F.coalesce(x.get("int"), x.get("double").try_cast("long"), F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long")))
        return Val({"int": F.when(made >= 0, made) if name == "uint" else made})
    if name == "double":
        return Val({"double": F.coalesce(x.get("double"), x.get("int").cast("double"), text.try_cast("double"))})
    if name == "bool":
        return Val({"boolean": F.coalesce(x.get("boolean"), F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False)))})
    if name == "string":
        return Val({"string": F.coalesce(text, x.get("int").cast("string"), x.get("double").cast("string"), x.get("boolean").cast("string"))})
    if name == "timestamp":
        return Val({"time": F.coalesce(x.get("time"), F.try_to_timestamp(text))})
    raise ExpressionError(f"no function '{name}' in plans")


def condition(node: Node, scope: Scope, said: str) -> Column:
    """A boolean in every row; an error stops the job with ``said``."""
    return F.coalesce(emit(node, scope).get("boolean"), F.raise_error(F.lit(said)).cast("boolean"))


def result(v: Val, said: str) -> Column:
    """The value as one column, null where it is an explicit null; an error stops the job with ``said``."""
    if not v.parts:
        return F.when(v.error(), F.raise_error(F.lit(said)).cast("string")) if v.null is None else F.lit(None)
    wrong = F.raise_error(F.lit(said))
    if len(v.parts) == 1:
        (c,) = v.parts.values()
        kind = next(iter(v.parts))
        if v.null is None and kind in TYPES:
            return F.coalesce(c, wrong.cast(TYPES[kind]))
        return c
    shown = F.coalesce(*(c.cast("variant") for c in v.parts.values()))
    return F.when(v.error(), wrong.cast("variant")).otherwise(shown)


__all__ = ["Scope", "Val", "condition", "emit", "literal", "result", "typed", "variant"]
