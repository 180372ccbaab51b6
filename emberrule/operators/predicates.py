"""The tests of one field, and of two, as Spark columns: two-valued, and native so that filters reach the scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import kind
from ..model import Join, Range, Test


@dataclass(frozen=True)
class Cell:
    """A field of a row. ``value`` is None where no such field can be; ``present`` is None where it always is."""

    value: Column | None
    kind: str = ""
    present: Column | None = None
    variant: Column | None = None
    dtype: T.DataType | None = None


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "float" if isinstance(t, (T.DoubleType, T.FloatType)) else "number"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "array" if isinstance(t, T.ArrayType) else "object"


def cell(df: DataFrame, path: str, finite: bool = False) -> Cell:
    """A column is explicit null where it is null and absent where the schema lacks it; VARIANT columns tell the two apart.

    NaN and infinities compare as null does, unless the table is declared ``finite``, which keeps its filters pushable.
    """
    first, *rest = path.split(".")
    names = {f.name: f.dataType for f in df.schema.fields}
    if first not in names:
        return Cell(None)
    column, dtype = F.col(f"`{first}`"), names[first]
    for i, s in enumerate(rest):
        if isinstance(dtype, T.VariantType):
            steps = "".join(f"[{x}]" if x.isdigit() else f"['{x}']" for x in rest[i:])
            v = F.try_variant_get(column, f"${steps}", "variant")
            return Cell(v, "variant", v.isNotNull(), v, dtype)
        if isinstance(dtype, T.StructType) and s in dtype.names:
            column, dtype = column.getField(s), dtype[s].dataType
        elif isinstance(dtype, T.ArrayType) and s.isdigit():
            column, dtype = F.get(column, F.lit(int(s))), dtype.elementType
        else:
            return Cell(None)
    if isinstance(dtype, T.VariantType):
        return Cell(column, "variant", column.isNotNull(), column, dtype)
    if isinstance(dtype, (T.DoubleType, T.FloatType)) and not finite:
        column = F.when(F.abs(column) < float("inf"), column)  # false of NaN too
    return Cell(column, kind_of(dtype), dtype=dtype)


def part(c: Cell, want: str) -> Column | None:
    """The cell's value if it is of a class, null otherwise; None if it can't be."""
    if c.value is None:
        return None
    if c.variant is None:
        return c.value if {"float": "number"}.get(c.kind, c.kind) == want or (c.kind == "time" and want in ("time", "string")) else None
    types = {"string": "STRING", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*"}.get(want)
    if types is None:
        return None
    target = {"string": "string", "boolean": "boolean", "number": "decimal(38,18)"}[want]
    return F.when(F.schema_of_variant(c.variant).rlike(f"^({types})$"), F.try_variant_get(c.variant, "$", target))


def _is_null(c: Cell) -> Column:
    if c.value is None:
        return F.lit(False)
    return F.coalesce(F.is_variant_null(c.variant), F.lit(False)) if c.variant is not None else c.value.isNull()


def _no(x: Column) -> Column:
    return ~F.coalesce(x, F.lit(False))


def _equal(c: Cell, v: Any) -> Column:
    if v is None:
        return _is_null(c)
    x = part(c, kind(v))
    return F.lit(False) if x is None else x == F.lit(v)


def test_column(c: Cell, t: Test | Range) -> Column:
    """A test that may be null where it is false; filters treat both alike and ``negated`` settles it."""
    if isinstance(t, Range):
        parts = []
        for bound, inclusive, low in ((t.low, t.low_inclusive, True), (t.high, t.high_inclusive, False)):
            if bound is not None:
                x = part(c, kind(bound))
                b = F.lit(bound)
                parts.append(F.lit(False) if x is None else (x >= b if inclusive else x > b) if low else (x <= b if inclusive else x < b))
        return reduce(lambda a, b: a & b, parts)
    if t.op == "eq":
        return _equal(c, t.value)
    if t.op == "ne":
        return _no(_equal(c, t.value))
    if t.op in ("in", "notIn"):
        by_kind: dict[str, list] = {}
        for v in t.value:
            by_kind.setdefault(kind(v), []).append(v)
        parts = [_is_null(c)] if by_kind.pop("null", None) else []
        for k, values in by_kind.items():
            x = part(c, k)
            if x is not None:
                parts.append(x.isin(*values))
        found = reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(False)) if len(parts) != 1 else parts[0]
        return found if t.op == "in" else _no(found)
    if t.op == "matches":
        x = part(c, "string")
        return F.lit(False) if x is None or c.kind == "time" else x.rlike(t.value)
    if t.op == "hasField":
        here = F.lit(c.value is not None) if c.present is None else c.present
        return here if t.value else ~here
    if t.op == "isNull":
        return _is_null(c) if t.value else ~_is_null(c)
    raise ValueError(t.op)


def join_column(mine: Cell, other: Cell, j: Join) -> Column:
    """A test of a field against another fact's. Equal nulls are equal; absent fields are not."""
    if mine.value is None or other.value is None:
        return F.lit(j.op in ("ne", "notIn"))
    if j.op in ("in", "notIn"):
        found = F.coalesce(F.array_contains(other.value, mine.value), F.lit(False))
        return found if j.op == "in" else ~found
    a = {"float": "number"}.get(mine.kind, mine.kind)
    b = {"float": "number"}.get(other.kind, other.kind)
    if a != b or mine.variant is not None:
        both = [(part(mine, k), part(other, k)) for k in ("number", "string", "boolean")]
        both = [(x, y) for x, y in both if x is not None and y is not None]
    else:
        both = [(mine.value, other.value)]
    if j.op in ("eq", "ne"):
        same = [x.eqNullSafe(y) if mine.variant is None else x == y for x, y in both]
        if mine.variant is not None:
            same.append(_is_null(mine) & _is_null(other))
        eq = reduce(lambda p, q: F.coalesce(p, F.lit(False)) | F.coalesce(q, F.lit(False)), same) if same else F.lit(False)
        return eq if j.op == "eq" else _no(eq)
    out = []
    for x, y in both:
        if j.op in ("after", "before"):
            # The span of numbers is in their own units, that of times in seconds.
            span = F.make_dt_interval(secs=F.lit(float(j.within))) if a == "time" else F.lit(j.within)
            out.append((y < x) & (x <= y + span) if j.op == "after" else (y - span <= x) & (x < y))
        else:
            out.append({"gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y}[j.op])
    return reduce(lambda p, q: p | q, out) if out else F.lit(False)


def negated(x: Column) -> Column:
    return _no(x)
