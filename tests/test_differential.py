"""Random expressions: the column compiler against the evaluator for single values."""

import math
import random
from datetime import date, datetime

import pytest
from pyspark.errors import AnalysisException

from quillframe.functions.columns import NotStatic, column
from quillframe.functions.values import evaluate, format_value, from_python
from quillframe.operators import statements
from quillframe.operators.compiler import Compiler, shown
from quillframe.plans.nodes import Assign, Binary, Call, Drop, Field, ListOf, Literal, Rename, Select, Unary, Update
from quillframe.sources.documents import RowError, apply

ROWS = [
    # s, n, i, d, b, t, dt, l, m
    ("12", "abc", 7, 2.5, True, datetime(2024, 3, 1), date(2024, 3, 1), ["a", "b", "a"], [1, 2, 2]),
    ("0x1F", "x y", 0, -0.5, False, datetime(2024, 3, 1, 10, 20, 30), date(2023, 2, 28), [], [7]),
    (None, None, None, None, None, None, None, None, None),
    ("false", "a\nb", -3, 1e9, True, datetime(1999, 12, 31, 23, 59, 59), date(2000, 2, 29), ["12"], [-3, 0]),
    ("", "", 2**62, 0.0, False, datetime(2024, 3, 2), date(1970, 1, 1), ["x", None], []),
    ("2024-03-01", "[[ref|title]]", 100000, 123456.789, True, datetime(2024, 3, 1), date(2024, 3, 1), ["true", "TRUE"], [100000]),
    ("010", "[t](r)", -8, 7.0, False, datetime(2020, 1, 1, 0, 0, 1), date(2020, 1, 1), ["a b", "é"], [8, 8, 7]),
    ("1.5e3", "éÉß%_\\", 1, 1500.0, True, datetime(2001, 9, 9, 1, 46, 40), date(2001, 9, 9), ["ß"], [1, None]),
    (" 42 ", "two  words", 10, float("inf"), False, datetime(2010, 5, 5, 5), date(2010, 5, 5), ["b", "a"], [10]),
    ("nan", "aab", 5, 1e-7, True, datetime(2012, 12, 12), date(2012, 12, 12), ["5"], [5, 5]),
]
DDL = "s string, n string, i bigint, d double, b boolean, t timestamp_ntz, dt date, l array<string>, m array<bigint>"
NAMES = ["s", "n", "i", "d", "b", "t", "dt", "l", "m"]
KINDS = ["any", "any", "any", "any", "string", "int", "number", "bool", "date", "datetime", "list", "link", "mdlink"]
LITERALS = [Literal("int", "0"), Literal("int", "7"), Literal("int", "-3"), Literal("number", "2.5"), Literal("string", "a"), Literal("string", "12"), Literal("string", ""), Literal("string", "2024-03-01"), Literal("bool", "true"), Literal("null", "null"), Literal("number", "7.0")]
CALLS = {
    "lower": 1, "upper": 1, "length": 1, "substr": (2, 3), "starts_with": 2, "ends_with": 2, "contains_substr": 2, "trim": (1, 2), "ltrim": (1, 2), "rtrim": (1, 2), "replace": 3,
    "split": 2, "concat": (2, 3), "to_string": 1, "abs": 1, "ceil": 1, "floor": 1, "round": (1, 2), "mod": 2, "sqrt": 1, "greatest": (1, 3), "least": (1, 3), "coalesce": (1, 3),
    "array_length": 1, "array_contains": 2, "array_concat": (1, 3), "distinct": 1, "array_to_string": 2, "year": 1, "month": 1, "day": 1, "date_diff": 2, "unknown": 1,
}


def expression(r: random.Random, depth: int):
    roll = r.random()
    if depth == 0 or roll < 0.2:
        return Field(r.choice(NAMES + ["missing"]), r.choice(KINDS)) if r.random() < 0.75 else r.choice(LITERALS)
    sub = lambda: expression(r, depth - 1)
    if roll < 0.55:
        op = r.choice(["and", "or", "=", "!=", "<", "<=", ">", ">=", "<=>", ">=<", "+", "-", "*", "/", "=", "<", "=", "!="])
        return Binary(op, sub(), sub())
    if roll < 0.65:
        return Binary(r.choice(["like", "not like", "ilike", "not ilike", "regexp", "not regexp"]), sub(), Literal("string", r.choice(["a%", "%", "_b%", "12", "^a", "[0-9]+", "(", "É%", "a.b", "x|y$"])))
    if roll < 0.73:
        return Unary(r.choice(["not", "neg"]), sub())
    if roll < 0.78:
        return ListOf(tuple(sub() for _ in range(r.randint(0, 3))))
    if roll < 0.82:
        return Call(r.choice(["regexp_contains", "regexp_extract"]), (sub(), Literal("string", r.choice(["a", "([a-z])b?", "[0-9]+", "(x)?y", "("]))))
    name = r.choice(list(CALLS))
    n = CALLS[name]
    return Call(name, tuple(sub() for _ in range(n if isinstance(n, int) else r.randint(*n))))


def alike(a: str | None, b: str | None) -> bool:
    if a == b:
        return True
    try:
        return a is not None and b is not None and math.isclose(float(a), float(b), rel_tol=1e-12)
    except ValueError:
        return False


@pytest.mark.parametrize("seed", range(int(__import__("os").environ.get("SEEDS", "6"))))
def test_random_expressions(spark, seed):
    r = random.Random(seed)
    df = spark.createDataFrame(ROWS, DDL).coalesce(1)
    rows = [dict(zip(NAMES, row)) for row in ROWS]
    compiler, cases = Compiler(df.schema), []
    with statements.legacy(spark):
        while len(cases) < 40:
            e = expression(r, r.choice([1, 2, 2, 3]))
            try:
                v = compiler.value(e)
                df.select(shown(v))
                cases.append((e, shown(v), v.kind))
            except (NotStatic, AnalysisException) as x:
                assert isinstance(x, NotStatic) or "LAMBDA_FUNCTION_WITH_PYTHON_UDF" in x.getCondition(), e
        got = df.select(*(c.alias(f"c{i}") for i, (_, c, _) in enumerate(cases))).collect()
    for i, (e, _, kind) in enumerate(cases):
        for row, out in zip(rows, got):
            want = evaluate(e, row)
            text = None if want is None else format_value(want)
            assert alike(text, out[i]), f"{e}\n{kind} {row}\n{text!r} {out[i]!r}"


@pytest.mark.parametrize("seed", range(int(__import__("os").environ.get("SEEDS", "4"))))
def test_random_conditions(spark, seed):
    """WHERE keeps the rows that the evaluator finds true."""
    from quillframe.functions.values import truthy

    r = random.Random(100 + seed)
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(ROWS)], "k int, " + DDL).coalesce(1)
    rows = [dict(zip(NAMES, row)) for row in ROWS]
    done = 0
    while done < 25:
        e = expression(r, 2)
        try:
            found = {x.k for x in statements.select(df, Select(("t",), (Field("k"),), where=e)).collect()}
        except (NotStatic, AnalysisException):
            continue
        done += 1
        assert found == {k for k, row in enumerate(rows) if truthy(evaluate(e, row))}, e


def test_values_of_rows():
    assert [from_python(x)[0] for x in ROWS[0]] == ["string", "string", "int", "number", "bool", "date", "date", "list", "list"]


def mutation(r: random.Random):
    where = expression(r, 1) if r.random() < 0.5 else None
    roll = r.random()
    if roll < 0.75:
        assigns = []
        for _ in range(r.randint(1, 3)):
            target, op = Field(r.choice([*NAMES, "new", "other"]), r.choice(["any"] * 4 + KINDS)), r.choice(["=", "=", "+=", "-=", None])
            assigns.append(Assign(target) if op is None else Assign(target, op, expression(r, 1)))
        return Update(("t",), tuple(assigns), where)
    if roll < 0.87:
        return Drop(("t",), tuple(Field(r.choice([*NAMES, "zz"])) for _ in range(r.randint(1, 2))), where)
    return Rename(("t",), tuple((r.choice([*NAMES, "zz"]), r.choice([*NAMES, "nn"])) for _ in range(r.randint(1, 2))), where)


@pytest.mark.parametrize("seed", range(3))
def test_random_mutations(spark, seed):
    """Tables against single rows. A column has one type, so a scalar in a column of lists is a list of one."""
    r = random.Random(seed)
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(ROWS)], "k bigint, " + DDL).coalesce(1)
    for _ in range(8):
        q = mutation(r)
        try:
            out = statements.mutate(df, q)
            with statements.legacy(spark):
                texts = out.select("k", *(shown(column(n, out.schema[n].dataType)).alias(n) for n in out.columns if n != "k"))
        except (NotStatic, AnalysisException):
            continue
        got = {x.k: x.asDict() for x in texts.collect()}
        for k, row in enumerate(ROWS):
            want = dict(zip(NAMES, row))
            try:
                apply(q, want)
                failed = False
            except RowError:
                want, failed = dict(zip(NAMES, row)), True
            assert failed == (got[k].get("_error") is not None), (q, row)
            for name in (set(want) | set(got[k])) - {"k", "_error"}:
                text = None if want.get(name) is None else format_value(from_python(want[name]))
                assert alike(text, got[k].get(name)) or f"[{text}]" == got[k].get(name), (q, row, name)
