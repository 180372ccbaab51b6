"""Comparison of JSON values: two-valued, by class, absent and null apart."""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal
from typing import Any


class _Absent:
    def __repr__(self) -> str:
        return "absent"


ABSENT: Any = _Absent()


def kind(v: Any) -> str:
    if v is ABSENT:
        return "absent"
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float, Decimal)):
        return "number" if math.isfinite(v) else "nonfinite"
    return {str: "string", list: "array", tuple: "array", dict: "object"}[type(v)]


def number(v: Any) -> Any:
    return Decimal(repr(v)) if isinstance(v, float) else v


def equal(a: Any, b: Any) -> bool:
    k = kind(a)
    if k != kind(b) or k in ("absent", "nonfinite"):
        return False
    if k == "number":
        return number(a) == number(b)
    if k == "array":
        return len(a) == len(b) and all(map(equal, a, b))
    if k == "object":
        return a.keys() == b.keys() and all(equal(a[x], b[x]) for x in a)
    return a == b


def order(a: Any, b: Any) -> int | None:
    """-1, 0 or 1 for two numbers or two strings (by UTF-16 units), else None."""
    k = kind(a)
    if k != kind(b) or k not in ("number", "string"):
        return None
    x, y = (number(a), number(b)) if k == "number" else (a.encode("utf-16-be"), b.encode("utf-16-be"))
    return (x > y) - (x < y)


def ordered(op: str, a: Any, b: Any) -> bool:
    c = order(a, b)
    return c is not None and {"gt": c > 0, "gte": c >= 0, "lt": c < 0, "lte": c <= 0}[op]


def test(op: str, actual: Any, operand: Any, within: Any = None) -> bool:
    """One operator on one value; negations are of the whole answer, so true where nothing is there."""
    if op == "eq":
        return equal(actual, operand)
    if op == "ne":
        return not equal(actual, operand)
    if op in ("gt", "gte", "lt", "lte"):
        return ordered(op, actual, operand)
    if op in ("in", "notIn"):
        found = isinstance(operand, (list, tuple)) and any(equal(actual, x) for x in operand)
        return found == (op == "in")
    if op == "matches":
        return isinstance(actual, str) and re.search(operand, actual) is not None
    if op == "hasField":
        return (actual is not ABSENT) == operand
    if op == "isNull":
        return (actual is None) == operand
    if op in ("after", "before"):
        if kind(actual) != "number" or kind(operand) != "number":
            return False
        mine, other, span = number(actual), number(operand), number(within)
        return other < mine <= other + span if op == "after" else other - span <= mine < other
    raise ValueError(op)


def segments(path: str) -> list[str]:
    if path == "":
        return []
    parts = path.split(".")
    if "" in parts:
        raise ValueError(f"empty segment in path '{path}'")
    return parts


def get(payload: Any, path: str) -> Any:
    """The value at a dotted path; a segment of digits is an index of an array or a key of an object."""
    for s in segments(path):
        if isinstance(payload, dict) and s in payload:
            payload = payload[s]
        elif isinstance(payload, list) and s.isdigit() and int(s) < len(payload):
            payload = payload[int(s)]
        else:
            return ABSENT
    return payload


def put(payload: dict, path: str, value: Any) -> dict:
    """A copy of ``payload`` with ``value`` at ``path``; objects on the way are made, arrays can't be written into."""
    first, *rest = segments(path)
    if not isinstance(payload, dict):
        raise ValueError("only objects have fields to set")
    out = dict(payload)
    if rest:
        inner = out.get(first, {})
        if isinstance(inner, list):
            raise ValueError(f"'{path}' writes into an array")
        out[first] = put(inner if isinstance(inner, dict) else {}, ".".join(rest), value)
    else:
        out[first] = value
    return out


def loads(text: str) -> Any:
    return json.loads(text, parse_float=Decimal)


def dumps(v: Any) -> str:
    if isinstance(v, Decimal):
        return str(v) if v.is_finite() else "null"
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{dumps(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(dumps, v)) + "]"
    return json.dumps(None if v is ABSENT or kind(v) == "nonfinite" else v, ensure_ascii=False)
