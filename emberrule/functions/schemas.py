"""Optional schemas of fact types: a subset of JSON Schema, checked at insert and update and when rules are compiled."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from .values import equal, kind, number, segments

_OPAQUE = ("$ref", "allOf", "anyOf", "oneOf", "not", "if")


def problems(schema: Any, value: Any, root: Any = None, at: str = "") -> list[str]:
    """What is wrong with a value. References stay within the schema; nothing is fetched."""
    root = schema if root is None else root
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [f"{at or 'the payload'} is not allowed"]
    out: list[str] = []
    say = lambda m: out.append(f"{at or 'the payload'} {m}")
    if "$ref" in schema:
        target = root
        for s in schema["$ref"].removeprefix("#").strip("/").split("/"):
            target = target[s.replace("~1", "/").replace("~0", "~")] if s else target
        out += problems(target, value, root, at)
    if "type" in schema:
        wanted = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        k = kind(value)
        if not (k in wanted or (k == "number" and "integer" in wanted and number(value) == int(number(value)))):
            say(f"is no {' or '.join(wanted)}")
            return out
    if "enum" in schema and not any(equal(value, x) for x in schema["enum"]):
        say("is none of the enumerated values")
    if "const" in schema and not equal(value, schema["const"]):
        say("isn't the constant")
    if kind(value) == "number":
        v = number(value)
        for key, bad in (("minimum", lambda b: v < b), ("maximum", lambda b: v > b), ("exclusiveMinimum", lambda b: v <= b), ("exclusiveMaximum", lambda b: v >= b)):
            if key in schema and bad(number(schema[key])):
                say(f"breaks {key} {schema[key]}")
        if "multipleOf" in schema and v % number(schema["multipleOf"]):
            say(f"is no multiple of {schema['multipleOf']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            say("has the wrong length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            say("doesn't match the pattern")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            say("has the wrong number of items")
        for i, x in enumerate(value):
            out += problems(schema.get("items", True), x, root, f"{at}.{i}".strip("."))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", ()):
            if k not in value:
                say(f"lacks '{k}'")
        for k, x in value.items():
            out += problems(known[k] if k in known else schema.get("additionalProperties", True), x, root, f"{at}.{k}".strip("."))
    for s in schema.get("allOf", ()):
        out += problems(s, value, root, at)
    if "anyOf" in schema and all(problems(s, value, root, at) for s in schema["anyOf"]):
        say("fits none of anyOf")
    if "oneOf" in schema and sum(not problems(s, value, root, at) for s in schema["oneOf"]) != 1:
        say("doesn't fit exactly one of oneOf")
    if "not" in schema and not problems(schema["not"], value, root, at):
        say("fits what it must not")
    return out


def validator(schemas: dict[str, Any]) -> Callable[[str, Any], list[str]]:
    """For ``Options.validate``: types without a schema may hold anything."""
    return lambda fact, payload: problems(schemas[fact], payload) if fact in schemas else []


def type_of(schema: Any, path: str) -> tuple[str, bool] | None:
    """(JSON type, always there) of a path; None where the schema doesn't say."""
    required = True
    for s in segments(path):
        if not isinstance(schema, dict) or any(k in schema for k in _OPAQUE) or schema.get("type") != "object" or s not in schema.get("properties", {}):
            return None
        required = required and s in schema.get("required", ())
        schema = schema["properties"][s]
    if not isinstance(schema, dict) or any(k in schema for k in _OPAQUE) or not isinstance(schema.get("type"), str):
        return None
    return {"integer": "number"}.get(schema["type"], schema["type"]), required


class KnownTypes(dict):
    """For ``compile_rules(schemas=...)``: what the schemas say about each tested path."""

    def __init__(self, schemas: dict[str, Any]):
        super().__init__({fact: _Paths(s) for fact, s in schemas.items()})


class _Paths(dict):
    def __init__(self, schema: Any):
        super().__init__()
        self.schema = schema

    def __contains__(self, path: object) -> bool:
        return type_of(self.schema, str(path)) is not None

    def __getitem__(self, path: str) -> tuple[str, bool]:
        found = type_of(self.schema, path)
        if found is None:
            raise KeyError(path)
        return found
