from decimal import Decimal

import pytest

from emberrule.functions.expressions import ExpressionError, evaluate, parse
from emberrule.functions.values import ABSENT, dumps, equal, get, loads, order, put
from emberrule.functions.values import test as check

MATRIX = [  # actual, op, operand, expected
    (ABSENT, "hasField", True, False), (ABSENT, "hasField", False, True), (None, "hasField", True, True), ("P", "hasField", False, False),
    (ABSENT, "isNull", True, False), (ABSENT, "isNull", False, True), (None, "isNull", True, True), (None, "isNull", False, False), (42, "isNull", False, True),
    (ABSENT, "eq", None, False), (None, "eq", None, True), ("P", "eq", None, False), (ABSENT, "eq", "P", False), (None, "eq", "P", False), ("P", "eq", "P", True), (42, "eq", "P", False),
    (ABSENT, "ne", None, True), (None, "ne", None, False), ("P", "ne", None, True), (ABSENT, "ne", "P", True), (None, "ne", "P", True), ("P", "ne", "P", False), (42, "ne", "P", True),
    (ABSENT, "gt", 1, False), (None, "gt", 1, False), (42, "gt", 1, True), ("P", "gt", 1, False), (True, "gt", 0, False), ("b", "gt", "a", True),
    (ABSENT, "in", ["P"], False), (None, "in", [None], True), (None, "in", ["P"], False), ("P", "in", ["S", "P"], True), (42, "in", ["P"], False),
    (ABSENT, "notIn", ["P"], True), (None, "notIn", [None], False), ("P", "notIn", ["P"], False), (42, "notIn", ["P"], True),
    (ABSENT, "matches", "a", False), (42, "matches", "4", False), ("bab", "matches", "a", True), (True, "eq", 1, False), (float("nan"), "eq", float("nan"), False), (float("nan"), "gt", 0, False),
]


@pytest.mark.parametrize("actual,op,operand,expected", MATRIX)
def test_matrix(actual, op, operand, expected):
    assert check(op, actual, operand) is expected


def test_numbers_and_structures():
    assert equal(10000, Decimal("10000.0")) and equal(1e4, 10000) and order(1, Decimal("1.5")) == -1
    assert equal({"a": 1, "b": [1, 2]}, {"b": [1.0, 2], "a": 1}) and not equal([1, 2], [2, 1])
    assert check("after", 11, 10, 1) and not check("after", 10, 10, 1) and not check("after", 12, 10, 1)
    assert check("before", 9, 10, 1) and not check("before", 10, 10, 1) and not check("before", 8, 10, 1)


def test_paths():
    p = loads('{"a": {"b": [1, {"0": 2}]}}')
    assert get(p, "a.b.0") == 1 and get(p, "a.b.1.0") == 2 and get(p, "a.c") is ABSENT and get(p, "") == p
    assert put({"x": 1}, "a.b", 2) == {"x": 1, "a": {"b": 2}}
    with pytest.raises(ValueError):
        put({"a": [1]}, "a.0", 2)
    with pytest.raises(ValueError):
        get(p, "a..b")
    assert dumps({"a": Decimal("1.50"), "b": None, "c": [True]}) == '{"a":1.50,"b":null,"c":[true]}'


@pytest.mark.parametrize("text,expected", [
    ("o.a > 5 && (o.s == 'x' || o.missing)", True), ("1 + 2 * 3 == 7", True), ("-7 / 2", -3), ("-7 % 2", -1), ("has(o.a) ? 'y' : 'n'", "y"), ("!has(o.zz)", True),
    ("o.l.exists(x, x > 2)", True), ("o.l.all(x, x > 2)", False), ("o.l.map(x, x * 2)", [2, 4, 6]), ("o.l.filter(x, x > 1).size()", 2), ("o.l.exists_one(x, x == 2)", True),
    ("'ab'.startsWith('a') && 'ab'.contains('b') && 'ab'.matches('^a')", True), ("2 in o.l", True), ("o.a < 7.5", True), ("size('abc')", 3), ("o.l[1]", 2),
])
def test_expressions(text, expected):
    assert evaluate(parse(text), {"o": {"a": 7, "s": "x", "l": [1, 2, 3]}}) == expected


@pytest.mark.parametrize("text", ["o.zz", "o.a + 1.5", "o.s > 1", "o.s && true", "o.a / 0", "nope(1)", "q"])
def test_expression_errors(text):
    with pytest.raises(ExpressionError):
        evaluate(parse(text), {"o": {"a": 7, "s": "x"}})


@pytest.mark.parametrize("text", ["1 +", "(1", "a..b", "1 2", "@", "(" * 50 + "1" + ")" * 50])
def test_expression_syntax(text):
    with pytest.raises(ExpressionError):
        parse(text)
