import math
from datetime import datetime

import pytest

from quillframe.functions.scalars import format_float, parse_float, parse_int
from quillframe.functions.values import CastError, cast, compare, evaluate, order, truthy
from quillframe.plans.parser import parse_expression


def value(text, **row):
    return evaluate(parse_expression(text), row)


DAY, MOMENT = ("date", datetime(2026, 10, 30)), ("datetime", datetime(2026, 10, 30, 1, 2, 3))
#: For each source, the kinds it can become and what it becomes.
CASTS = [
    (("bool", True), {"int": 1, "number": 1.0, "string": "true"}),
    (("int", 1), {"bool": True, "number": 1.0, "string": "1"}),
    (("int", 5), {"number": 5.0, "string": "5"}),
    (("number", 2.0), {"int": 2, "string": "2"}),
    (("number", 2.5), {"string": "2.5"}),
    (("string", "TRUE"), {"bool": True}),
    (("string", "0x1F"), {"int": 31}),
    (("string", "010"), {"int": 8, "number": 10.0}),
    (("string", "2026-10-30"), {"date": DAY[1]}),
    (("string", "2026-10-30T01:02:03"), {"datetime": MOMENT[1]}),
    (("string", "[[r|t]]"), {"link": "[[r|t]]", "mdlink": "[t](r)"}),
    (("string", "[t](r)"), {"link": "[[r|t]]", "mdlink": "[t](r)"}),
    (("string", "[r](r)"), {"link": "[[r]]", "mdlink": "[r](r)"}),
    (DAY, {"string": "2026-10-30"}),
    (MOMENT, {"string": "2026-10-30T01:02:03"}),
    (("link", "[[r]]"), {"string": "[[r]]", "mdlink": "[r](r)"}),
    (("mdlink", "[t](r)"), {"string": "[t](r)", "link": "[[r|t]]"}),
    (("list", [("string", "7")]), {"int": 7, "number": 7.0, "string": "7"}),
]


@pytest.mark.parametrize(("source", "wanted"), CASTS)
def test_cast_matrix(source, wanted):
    for kind in ("bool", "int", "number", "string", "date", "datetime", "link", "mdlink"):
        if kind == source[0]:
            continue
        if kind in wanted:
            assert cast(source, kind) == (kind, wanted[kind])
        else:
            with pytest.raises(CastError):
                cast(source, kind)


def test_casts_to_list_and_of_null():
    assert cast(("int", 3), "list") == ("list", [("string", "3")])
    assert cast(("list", [("int", 1), ("bool", True)]), "list") == ("list", [("string", "1"), ("string", "true")])
    for kind in ("any", "string", "list", "int"):
        with pytest.raises(CastError):
            cast(None, kind)
    with pytest.raises(CastError):
        cast(("list", [("int", 1), ("int", 2)]), "int")


@pytest.mark.parametrize(("text", "n"), [("42", 42), ("-0x10", -16), ("0b101", 5), ("0o17", 15), ("017", 15), ("1_000", 1000), ("08", None), ("", None), (" 1", None), ("9223372036854775808", None), ("1.0", None)])
def test_integers(text, n):
    assert parse_int(text) == n


@pytest.mark.parametrize(("text", "x"), [("1.5", 1.5), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("-Inf", -math.inf), ("0x1p4", 16.0), ("1e999", None), ("5d", None), ("", None), ("1_0", None)])
def test_numbers(text, x):
    assert parse_float(text) == x


@pytest.mark.parametrize(("x", "text"), [(5.0, "5"), (1234567.0, "1.234567e+06"), (100000.0, "100000"), (0.0001, "0.0001"), (0.00001, "1e-05"), (-2.5, "-2.5"), (1e21, "1e+21"), (math.nan, "NaN"), (math.inf, "+Inf"), (0.1 + 0.2, "0.30000000000000004"), (123456.7, "123456.7")])
def test_numbers_as_text(x, text):
    assert format_float(x) == text


def test_null_logic_has_two_values():
    assert value("null = null")[1] is True
    assert value("null != 1")[1] is True
    assert value("null < 1")[1] is False
    assert value("not missing")[1] is True
    assert not truthy(None) and not truthy(("string", "False")) and truthy(("string", "0")) and not truthy(("list", []))


def test_equality_converts():
    assert value("true = 1")[1] and value("'1' = 1.0")[1] and not value("'1' = '1.0'")[1]
    assert compare("=", DAY, ("string", "2026-10-30")) and not compare("=", DAY, MOMENT)
    assert not compare("<", DAY, MOMENT) and not compare("<", ("string", "a"), ("string", "b"))


def test_lists():
    assert value("[1, 2, 2] = [2, 1, 2]")[1] and not value("[1] = 1")[1] and not value("[1] != 1")[1]
    assert value("['a', 1] >= '1'")[1] and value("3 <= [1, 3]")[1]
    assert value("['a', 'a', 'b'] <=> ['a']") == ("list", [("string", "a")] * 2)
    assert value("['a', 'a'] >=< ['a', 'c', 'c']") == ("list", [("string", "a"), ("string", "a"), ("string", "c")])
    assert value("null <=> [1]") is None


@pytest.mark.parametrize(
    ("text", "result"),
    [
        ("'a\\nb' like 'a%b'", False), ("r'a\\xb' like r'a\\%b'", True), ("'a%b' like r'a\\%b'", False), ("'É' ilike 'é'", True), ("'xay' regexp 'a'", True), ("'a' regexp '('", None), ("null not like 'a'", None), ("'ab' not like 'a_'", False),
        ("'foo' regexp '^f(?=o)'", None),
    ],
)
def test_patterns(text, result):
    v = value(text)
    assert (v and v[1]) == result


def test_arithmetic():
    assert value("7 / 2") == ("number", 3.5) and value("6 / 2") == ("int", 3) and value("1 / 0") is None
    assert value("9223372036854775807 + 1") == ("int", -(2**63))
    assert value("'a' + 1") is None and value("-'1'") is None and value("'1' + 1") == ("number", 2.0)


@pytest.mark.parametrize(
    ("text", "result"),
    [
        ("substr('hello', -10, 3)", "hel"), ("substr('hello', 0, 2)", "he"), ("substr('hello', -2)", "lo"), ("substr('hello', 9)", ""), ("substr('hello', 2, -1)", ""),
        ("trim('\\t x \\n')", "x"), ("ltrim('xxa', 'x')", "a"), ("replace('ab', '', '-')", "-a-b-"), ("concat('a', 1, true)", "a1true"), ("concat('a', null)", None), ("concat('a')", None),
        ("regexp_extract('k=v', '(\\\\w)=(\\\\w)')", "k"), ("regexp_extract('abc', 'x')", None), ("upper('straße')", "STRAßE"), ("length('café')", 4), ("length(123)", 3),
        ("abs(-3)", 3), ("abs('-2.5')", 2.5), ("ceil(1.2)", 2), ("floor(-1.2)", -2), ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("round(1.005, 2)", 1.0), ("round(123, -1)", 120.0), ("mod(-7, 3)", -1), ("mod(1.5, 2)", None), ("mod(1, 0)", None),
        ("pow(2, 10)", 1024.0), ("greatest(1, 2.5, null)", 2.5), ("least('b', 'a')", "b"), ("coalesce(null, missing, 'x')", "x"), ("array_length('x')", 1), ("array_length([1, 2])", 2),
        ("array_contains([1, null], 2)", False), ("array_contains(null, 2)", None), ("array_to_string(['a', 1], '-')", "a-1"), ("array_to_string(['a', null], '-')", None),
        ("year('2024-02-03')", 2024), ("month('2024-02-03T10:00:00')", 2), ("day('nonsense')", None), ("date_diff('2024-03-01', '2024-02-28')", 2), ("date_diff('2024-03-01T00:00:00', '2024-02-28')", None),
        ("nothing_like_this(1)", None), ("to_string(1e6)", "1e+06"), ("sqrt(4)", 2.0),
    ],
)
def test_functions(text, result):
    v = value(text)
    assert (v and v[1]) == result


def test_split():
    assert value("split('a,b,', ',')")[1] == [("string", "a"), ("string", "b"), ("string", "")]
    assert value("split('é!', '')")[1] == [("string", "é"), ("string", "!")] and value("split('', '')")[1] == []
    assert value("distinct(['a', 'b', 'a', 1, '1'])")[1] == [("string", "a"), ("string", "b"), ("int", 1)]


def test_fields_and_kinds_of_moments():
    assert value("d", d=datetime(2024, 1, 1)) == ("date", datetime(2024, 1, 1)) and value("d", d=datetime(2024, 1, 1, 5))[0] == "datetime"
    assert value("x:int", x="a") is None and value("x:int", x="7") == ("int", 7)
    assert value("date_diff(a, b)", a=datetime(2024, 1, 2, 1), b=datetime(2024, 1, 1, 23)) == ("int", 0)


def test_order():
    assert order(None, ("int", 1)) == 1 and order(("bool", True), ("number", 0.5)) == 1 and order(("string", "a"), ("string", "B")) == 1 and order(None, None) == 0
