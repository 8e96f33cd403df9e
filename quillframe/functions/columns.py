"""Values as columns: kinds known from the schema, casts and comparisons as native expressions.

A Typed column has one static kind. "temporal" is a timestamp column, whose
rows at midnight are dates and the others datetimes; "null" is null in every
row. The expressions must be built with ANSI mode off, so that 64-bit
arithmetic wraps and nothing throws; engine.legacy() sees to that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import format_float
from .values import Value, try_cast

NUMERIC = ("bool", "int", "number")
TEXT = ("string", "link", "mdlink")
TIME = ("date", "datetime", "temporal")
SPARK_TYPES = {"string": "string", "bool": "boolean", "int": "bigint", "number": "double", "date": "date", "datetime": "timestamp_ntz", "temporal": "timestamp_ntz", "link": "string", "mdlink": "string", "null": "string"}


class NotStatic(Exception):
    """The expression's kind depends on the row, so it has no native form."""


@dataclass(frozen=True)
class Typed:
    made: Column | Callable[[], Column]  # a constant is made on use, which needs a session
    kind: str
    item: str | None = None  # kind of a list's items; "mixed": only known from const
    const: Value | None = None
    is_const: bool = False
    inner: bool = False  # inside a function over a list, where no Python can run

    @property
    def col(self) -> Column:
        return self.made if isinstance(self.made, Column) else self.made()

    def as_type(self) -> Column:
        """The column in the type that its kind has in results."""
        if self.kind == "list":
            if self.item == "mixed":
                raise NotStatic("a list of several kinds")
            return self.col.cast(f"array<{SPARK_TYPES[self.item or 'string']}>")
        return self.col.cast(SPARK_TYPES[self.kind])


NULL = Typed(lambda: F.lit(None).cast("string"), "null", const=None, is_const=True)


def kind_of_type(t: T.DataType) -> tuple[str, str | None]:
    """(kind, item kind) of a column of a table."""
    if isinstance(t, T.ArrayType):
        inner, _ = kind_of_type(t.elementType)
        return "list", inner
    for kinds, kind in (((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"), ((T.FloatType, T.DoubleType, T.DecimalType), "number"), ((T.StringType, T.VarcharType, T.CharType), "string"), (T.BooleanType, "bool"), (T.DateType, "date"), ((T.TimestampType, T.TimestampNTZType), "temporal"), (T.NullType, "null")):
        if isinstance(t, kinds):
            return kind, None
    raise NotStatic(f"a column of type {t.simpleString()}")


def column(name: str, t: T.DataType) -> Typed:
    kind, item = kind_of_type(t)
    col = F.col("`" + name.replace("`", "``") + "`")
    if kind == "int" and not isinstance(t, T.LongType):
        col = col.cast("bigint")
    elif kind == "number" and not isinstance(t, T.DoubleType):
        col = col.cast("double")
    elif kind == "temporal" and not isinstance(t, T.TimestampNTZType):
        col = col.cast("timestamp_ntz")
    elif kind == "list":
        col = col.cast(f"array<{SPARK_TYPES[item]}>") if item in SPARK_TYPES else col
    return Typed(col, kind, item)


def constant(v: Value) -> Typed:
    """A value as a column."""
    if v is None:
        return NULL
    kind, x = v
    if kind == "any":
        raise NotStatic("a value of no known kind")
    if kind != "list":
        lit = F.lit(x) if kind not in ("int", "number") else F.lit(x).cast(SPARK_TYPES[kind])
        if kind in TIME:
            lit = F.lit(_iso(x)).cast("timestamp_ntz")
            lit = lit.cast("date") if kind == "date" else lit
        return Typed(lit, kind, const=v, is_const=True)
    kinds = {i[0] for i in x if i is not None}
    if kinds <= {"int", "number"} and len(kinds) == 2:
        kinds = {"number"}
        x = [i and ("number", float(i[1])) for i in x]
    if len(kinds) > 1 or kinds & {"list", "any"}:
        return Typed(F.lit(None), "list", "mixed", v, True)
    item = next(iter(kinds), "string")
    parts = [constant(i).col.cast(SPARK_TYPES[item]) for i in x]
    return Typed(F.array(*parts).cast(f"array<{SPARK_TYPES[item]}>"), "list", item, v, True)


def _iso(t: datetime) -> str:
    return t.replace(tzinfo=None).isoformat(sep=" ")


# -- casts; each gives null where there is no counterpart

def midnight(ts: Column) -> Column:
    return ts == ts.cast("date").cast("timestamp_ntz")


def number(t: Typed) -> Typed:
    return cast(t, "number")


def string(t: Typed) -> Typed:
    return cast(t, "string")


def integer(t: Typed) -> Typed:
    return cast(t, "int")


def item(x: Column, kind: str | None) -> Typed:
    """An item of a list, inside a function over it."""
    return Typed(x, kind, inner=True)


def cast(t: Typed, kind: str) -> Typed:
    if t.is_const and t.kind not in ("null", kind) and kind != "any":
        return constant(try_cast(t.const, kind))
    if t.kind == "null" or kind == "any":
        return t
    if kind == "list":
        return _list_of_strings(t)  # even of a list: its items become strings, and a null among them has none
    if t.kind == kind:
        return t
    if t.kind == "list":
        if t.item == "mixed":
            raise NotStatic("a list of several kinds")
        only = cast(Typed(F.get(t.col, F.lit(0)), t.item, inner=t.inner), kind)
        return NULL if only.kind == "null" else Typed(F.when(F.size(t.col) == 1, only.col), only.kind)
    if t.kind == "temporal" and kind in ("date", "datetime"):
        at = midnight(t.col)
        return Typed(F.when(at, t.col.cast("date")), "date") if kind == "date" else Typed(F.when(~at, t.col), "datetime")
    found = CASTS.get((t.kind, kind))
    if t.inner and found is _number_to_string:
        raise NotStatic("a number of a list as text")
    return NULL if found is None else Typed(found(t.col), kind)


def _list_of_strings(t: Typed) -> Typed:
    if t.kind != "list":
        s = string(t)
        return NULL if s.kind == "null" else Typed(F.when(s.col.isNotNull(), F.array(s.col)), "list", "string")
    if t.item == "mixed":
        raise NotStatic("a list of several kinds")
    strings = F.transform(t.col, lambda x: string(item(x, t.item)).col)
    return Typed(F.when(~F.exists(strings, lambda x: x.isNull()), strings), "list", "string")


def _string_to_int(s: Column) -> Column:
    plain = s.rlike(r"\A[+-]?(0|[1-9][0-9]*)\z")
    marked = s.rlike(r"\A[+-]?(0[xX](_?[0-9A-Fa-f])+|0[bB](_?[01])+|0[oO]?(_?[0-7])+|[1-9](_?[0-9])*)\z")
    digits = F.lower(F.regexp_replace(s, r"[+_-]", ""))
    value = (
        F.when(digits.startswith("0x"), F.conv(F.substring(digits, 3, 100), 16, 10))
        .when(digits.startswith("0b"), F.conv(F.substring(digits, 3, 100), 2, 10))
        .when(digits.startswith("0"), F.conv(F.regexp_replace(digits, "^0o?", ""), 8, 10))
        .otherwise(digits)
    )
    # conv() stops at 64 unsigned bits; more digits than those hold are no integer.
    room = F.length(F.regexp_replace(digits, "^0[xbo]?0*", "")) <= F.when(digits.startswith("0x"), 16).when(digits.startswith("0b"), 64).when(digits.startswith("0"), 22).otherwise(30)
    wide = F.when(room, value.try_cast("decimal(38,0)")) * F.when(s.startswith("-"), -1).otherwise(1)
    ranged = F.when((wide >= F.lit("-9223372036854775808").cast("decimal(38,0)")) & (wide <= F.lit("9223372036854775807").cast("decimal(38,0)")), wide.cast("bigint"))
    return F.when(plain, s.try_cast("bigint")).when(marked, ranged)


def _string_to_number(s: Column) -> Column:
    value = s.try_cast("double")
    inf = F.lit(float("inf"))
    return (
        F.when(s.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), F.when(F.abs(value) < inf, value))
        .when(s.rlike(r"(?i)\Anan\z"), F.lit(float("nan")))
        .when(s.rlike(r"(?i)\A[+-]?inf(inity)?\z"), F.when(s.startswith("-"), -inf).otherwise(inf))
    )


@F.udf(T.StringType(), useArrow=True)
def _format_number(x: float | None) -> str | None:
    return None if x is None else format_float(x)


def _number_to_string(x: Column) -> Column:
    # Whole numbers of up to six digits, by far the most, need no Python.
    return F.when((F.abs(x) < 1e6) & (x == F.floor(x)) & ~((x == 0) & (F.lit(1.0) / x < 0)), x.cast("bigint").cast("string")).otherwise(_format_number(x))


def _wiki(s: Column) -> tuple[Column, Column, Column]:
    """(valid, reference, title) of [[reference|title]]."""
    inner = F.substring(s, F.lit(3), F.length(s) - 4)
    bar = F.instr(inner, "|")
    ok = s.startswith("[[") & s.endswith("]]") & (F.length(s) >= 5)
    return ok, F.when(bar > 0, F.substring(inner, F.lit(1), bar - 1)).otherwise(inner), F.when(bar > 0, F.substring(inner, bar + 1, F.length(inner))).otherwise("")


def _mdlink(s: Column) -> tuple[Column, Column, Column]:
    """(valid, reference, title) of [title](reference)."""
    middle = F.instr(s, "](")
    ok = s.startswith("[") & s.endswith(")") & (middle > 0) & (F.length(s) >= 4)
    return ok, F.substring(s, middle + 2, F.length(s) - middle - 2), F.substring(s, F.lit(2), middle - 2)


def _as_wiki(parts: tuple[Column, Column, Column]) -> Column:
    ok, reference, title = parts
    return F.when(ok, F.when((title == "") | (title == reference), F.concat(F.lit("[["), reference, F.lit("]]"))).otherwise(F.concat(F.lit("[["), reference, F.lit("|"), title, F.lit("]]"))))


def _as_mdlink(parts: tuple[Column, Column, Column]) -> Column:
    ok, reference, title = parts
    return F.when(ok, F.concat(F.lit("["), F.when(title == "", reference).otherwise(title), F.lit("]("), reference, F.lit(")")))


def _stamp(t: Column) -> Column:
    return F.date_format(t.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")


def _day(t: Column) -> Column:
    return F.date_format(t.cast("date"), "yyyy-MM-dd")


def _string_to_date(s: Column) -> Column:
    return F.when(s.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), s.try_cast("date"))


def _string_to_datetime(s: Column) -> Column:
    return F.when(s.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?\z"), F.replace(s, F.lit(","), F.lit(".")).try_cast("timestamp_ntz"))


def _number_to_int(x: Column) -> Column:
    return F.when((x == F.floor(x)) & (x >= -(2.0**63)) & (x < 2.0**63), x.cast("bigint"))


#: (from, to) -> expression; what is missing has no counterpart.
CASTS: dict[tuple[str, str], Callable[[Column], Column]] = {
    ("bool", "int"): lambda x: x.cast("bigint"),
    ("bool", "number"): lambda x: x.cast("double"),
    ("bool", "string"): lambda x: x.cast("string"),
    ("int", "bool"): lambda x: F.when(x.isin(0, 1), x == 1),
    ("int", "number"): lambda x: x.cast("double"),
    ("int", "string"): lambda x: x.cast("string"),
    ("number", "bool"): lambda x: F.when(x.isin(0.0, 1.0), x == 1),
    ("number", "int"): _number_to_int,
    ("number", "string"): _number_to_string,
    ("string", "bool"): lambda s: F.when(F.lower(s).isin("true", "false"), F.lower(s) == "true"),
    ("string", "int"): _string_to_int,
    ("string", "number"): _string_to_number,
    ("string", "date"): _string_to_date,
    ("string", "datetime"): _string_to_datetime,
    ("string", "link"): lambda s: F.when(_wiki(s)[0], s).otherwise(_as_wiki(_mdlink(s))),
    ("string", "mdlink"): lambda s: F.when(_mdlink(s)[0], s).otherwise(_as_mdlink(_wiki(s))),
    ("date", "string"): _day,
    ("datetime", "string"): _stamp,
    ("temporal", "string"): lambda t: F.when(midnight(t), _day(t)).otherwise(_stamp(t)),
    ("link", "string"): lambda s: s,
    ("link", "mdlink"): lambda s: _as_mdlink(_wiki(s)),
    ("mdlink", "string"): lambda s: s,
    ("mdlink", "link"): lambda s: _as_wiki(_mdlink(s)),
}


# -- truth and equality

def truthy(t: Typed) -> Column:
    """Never null."""
    if t.kind == "null":
        return F.lit(False)
    test = {
        "bool": lambda x: x,
        "int": lambda x: x != 0,
        "number": lambda x: x != 0,
        "string": lambda x: (x != "") & (F.lower(x) != "false"),
        "list": lambda x: F.size(x) > 0,
    }.get(t.kind)
    if t.kind == "list" and t.item == "mixed":
        return F.lit(bool(t.const[1]))
    return t.col.isNotNull() if test is None else F.coalesce(test(t.col), F.lit(False))


def not_nan(*ts: Typed) -> Column | None:
    """A test that no number among ts is NaN, where one could be."""
    tests = [~F.isnan(t.col) for t in ts if t.kind == "number" and not t.is_const]
    out = None
    for x in tests:
        out = x if out is None else out & x
    return out


def equal_values(a: Typed, b: Typed) -> Column:
    """Equality of two scalars that are not null, or null where either is."""
    if a.kind == "list" or b.kind == "list":
        return F.lit(False)
    same = a.kind == b.kind or a.kind in TIME and b.kind in TIME and "temporal" in (a.kind, b.kind)
    if same:
        if a.kind in TIME:
            return a.col.cast("timestamp_ntz") == b.col.cast("timestamp_ntz")
        guard = not_nan(a, b) if a.kind == "number" and not (a.is_const or b.is_const) else None
        return a.col == b.col if guard is None else (a.col == b.col) & guard
    if a.kind in NUMERIC and b.kind in NUMERIC:
        return equal_values(number(a), number(b))
    x, y = number(a), number(b)
    s, u = string(a), string(b)
    texts = F.lit(False) if "null" in (s.kind, u.kind) else s.col == u.col
    if "null" in (x.kind, y.kind):
        return texts
    return F.when(x.col.isNotNull() & y.col.isNotNull(), equal_values(Typed(x.col, "number"), Typed(y.col, "number"))).otherwise(texts)


def elements(t: Typed) -> Typed:
    """t as a list: itself, or a list of it."""
    if t.kind == "list":
        return t
    return Typed(F.array(t.col), "list", t.kind, ("list", [t.const]) if t.is_const else None, t.is_const)


def one_of(x: Typed, items: Typed) -> Column:
    """Whether the list has an item equal to x. Never null where x is not."""
    if items.is_const:
        tests = [constant(v) for v in items.const[1] if v is not None]
        out = F.lit(False)
        for v in tests:
            out = out | F.coalesce(equal_values(x, v), F.lit(False))
        return out
    if items.item == x.kind and x.kind not in ("number", "temporal"):
        return F.coalesce(F.array_contains(items.col, x.col), F.lit(False))
    return F.coalesce(F.exists(items.col, lambda y: F.coalesce(equal_values(replace(x, inner=True), item(y, items.item)), F.lit(False))), F.lit(False))


def same_list(a: Typed, b: Typed) -> Column:
    """Equality as multisets of two lists that are not null."""
    if a.item != b.item:
        if a.item in NUMERIC and b.item in NUMERIC:
            a, b = (Typed(t.col.cast("array<double>"), "list", "number") for t in (a, b))
        elif a.is_const and not a.const[1] or b.is_const and not b.const[1]:
            return F.size(a.col) == F.size(b.col)
        else:
            raise NotStatic("lists of different kinds")
    return F.array_sort(a.col).eqNullSafe(F.array_sort(b.col))
