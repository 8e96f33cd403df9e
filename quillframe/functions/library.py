"""The scalar functions as columns. functions.values has the same ones for single values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns
from .columns import NULL, SPARK_TYPES, TIME, NotStatic, Typed, cast, constant, elements, equal_values, integer, number, one_of, string
from .values import ANY_NUMBER, try_cast

WHITE = " \t\n\r"


def _strings(result: str):
    """A function of strings: arguments are cast, and null if any of them is."""

    def wrap(f: Callable[..., Column]) -> Callable[..., Typed]:
        def call(*args: Typed) -> Typed:
            cols = [string(a) for a in args]
            return NULL if any(c.kind == "null" for c in cols) else Typed(f(*(c.col for c in cols)), result)

        return call

    return wrap


def upper(s: Column) -> Column:
    # One letter stays one letter, so the sharp s has no capital.
    held = F.lit("\ue000")
    return F.replace(F.upper(F.replace(s, F.lit("ß"), held)), held, F.lit("ß"))


def substr(s: Typed, position: Typed, *length: Typed) -> Typed:
    s, p, n = string(s), integer(position), [integer(x) for x in length]
    if "null" in (s.kind, p.kind, *(x.kind for x in n)):
        return NULL
    size = F.length(s.col).cast("bigint")
    start = F.greatest(F.lit(1), F.when(p.col < 0, size + p.col + 1).otherwise(p.col))
    # Past the end the length is never looked at, whatever it is.
    count = n[0].col if n else size
    part = F.when(count <= 0, F.lit("")).otherwise(F.substring(s.col, start.cast("int"), F.least(count, size).cast("int")))
    return Typed(F.when(s.col.isNull() | p.col.isNull(), F.lit(None)).when(start > size, F.lit("")).when(count.isNotNull(), part), "string")


def trimmed(f: Callable[[Column, Column], Column]) -> Callable[..., Typed]:
    def call(s: Typed, *chars: Typed) -> Typed:
        t, c = string(s), [string(x) for x in chars]
        if "null" in (t.kind, *(x.kind for x in c)):
            return NULL
        return Typed(f(t.col, c[0].col if c else F.lit(WHITE)), "string")

    return call


def replace(s: Typed, old: Typed, new: Typed) -> Typed:
    t = [string(x) for x in (s, old, new)]
    if any(x.kind == "null" for x in t):
        return NULL
    s, old, new = (x.col for x in t)
    # An empty text to replace stands before each character and at the end.
    spread = F.concat(new, F.array_join(F.transform(F.split(s, ""), lambda c: F.concat(c, new)), ""))
    between = F.when(s == "", new).otherwise(spread)
    return Typed(F.when(old == "", between).otherwise(F.replace(s, old, new)), "string")


def split(s: Typed, separator: Typed) -> Typed:
    s, by = string(s), string(separator)
    if "null" in (s.kind, by.kind):
        return NULL
    quoted = F.concat(F.lit("\\Q"), F.replace(by.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    if by.is_const:
        text = by.const[1]
        parts = F.filter(F.split(s.col, "", -1), lambda x: x != "") if text == "" else F.split(s.col, "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    else:
        parts = F.when(by.col == "", F.filter(F.split(s.col, "", -1), lambda x: x != "")).otherwise(F.split(s.col, quoted, -1))
    return Typed(parts, "list", "string")


def _pattern(p: Typed) -> tuple[str, str, int] | None:
    if not p.is_const:
        raise NotStatic("a pattern that differs by row")
    return None if string(p).kind == "null" else patterns.translate(_text(p))


def _text(p: Typed) -> str:
    return try_cast(p.const, "string")[1]


def regexp_contains(s: Typed, pattern: Typed) -> Typed:
    s, found = string(s), _pattern(pattern)
    return NULL if found is None or s.kind == "null" else Typed(s.col.rlike(found[0]), "bool")


def regexp_extract(s: Typed, pattern: Typed) -> Typed:
    s, found = string(s), _pattern(pattern)
    if found is None or s.kind == "null":
        return NULL
    return Typed(F.when(s.col.rlike(found[0]), F.regexp_extract(s.col, found[0], 1 if found[2] else 0)), "string")


def _numeric(t: Typed) -> Typed:
    return t if t.kind in ("int", "number") else number(t)


def absolute(v: Typed) -> Typed:
    v = _numeric(v)
    return v if v.kind == "null" else Typed(F.abs(v.col), v.kind)


def whole(f: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
    def call(v: Typed) -> Typed:
        v = _numeric(v)
        if v.kind in ("null", "int"):
            return v
        lowest = F.lit(-(2**63)).cast("bigint")
        return Typed(F.when(v.col.isNotNull(), F.when(F.abs(v.col) < 2.0**63, f(v.col).cast("bigint")).otherwise(lowest)), "int")

    return call


def rounded(x: Typed, *digits: Typed) -> Typed:
    x, d = number(x), integer(digits[0]) if digits else constant(("int", 0))
    if "null" in (x.kind, d.kind):
        return NULL
    factor = F.pow(F.lit(10.0), d.col.cast("double"))
    scaled = x.col * factor
    # Half away from zero on the scaled value itself, in binary.
    down = F.floor(F.abs(scaled)).cast("double")
    near = F.when(F.abs(scaled) >= 2.0**52, scaled).otherwise(F.signum(scaled) * (down + F.when(F.abs(scaled) - down >= 0.5, 1.0).otherwise(0.0)))
    return Typed(near / factor, "number")


def mod(x: Typed, y: Typed) -> Typed:
    x, y = integer(x), integer(y)
    return NULL if "null" in (x.kind, y.kind) else Typed(F.when(y.col != 0, x.col % y.col), "int")


def numbers(f: Callable[..., Column]) -> Callable[..., Typed]:
    def call(*args: Typed) -> Typed:
        cols = [number(a) for a in args]
        return NULL if any(c.kind == "null" for c in cols) else Typed(f(*(c.col for c in cols)), "number")

    return call


def extreme(f: Callable[..., Column]) -> Callable[..., Typed]:
    def call(*args: Typed) -> Typed:
        known = [a for a in args if a.kind != "null"]
        if not known:
            return NULL
        if len(known) == 1:
            return known[0]
        kinds = {a.kind for a in known}
        if kinds <= {"int", "number"}:
            same = known if len(kinds) == 1 else [number(a) for a in known]
            if same[0].kind == "number" and not all(a.is_const for a in same):
                # NaN is never less or greater, and stays if it comes first.
                rest = [F.when(~F.isnan(a.col), a.col) for a in same]
                best = f(*rest)
                return Typed(F.when(F.isnan(F.coalesce(*(a.col for a in same))), F.coalesce(*(a.col for a in same))).otherwise(best), "number")
            return Typed(f(*(a.col for a in same)), same[0].kind)
        if len(kinds) == 1 and kinds <= {"date", "datetime", "temporal", "link", "mdlink", "list"}:
            return coalesce(*known)
        raise NotStatic("arguments of several kinds")

    return call


def coalesce(*args: Typed) -> Typed:
    known = [a for a in args if a.kind != "null"]
    if not known:
        return NULL
    kinds = {(a.kind, a.item) for a in known}
    if len(kinds) > 1:
        if not {k for k, _ in kinds} <= {"int", "number"}:
            raise NotStatic("arguments of several kinds")
        known = [number(a) for a in known]
    return Typed(F.coalesce(*(a.col for a in known)), known[0].kind, known[0].item)


def array_length(v: Typed) -> Typed:
    if v.kind == "null":
        return NULL
    size = F.size(v.col).cast("bigint") if v.kind == "list" else F.lit(1).cast("bigint")
    return Typed(F.when(v.col.isNotNull(), size), "int")


def array_contains(v: Typed, x: Typed) -> Typed:
    if "null" in (v.kind, x.kind):
        return NULL
    if v.kind == "list" and x.kind == "list":
        raise NotStatic("a list as an item")
    found = one_of(x, v) if v.kind == "list" else F.coalesce(equal_values(v, x), F.lit(False))
    known = x.col.isNotNull() if v.item == "mixed" else v.col.isNotNull() & x.col.isNotNull()
    return Typed(F.when(known, found), "bool")


def alike(args: tuple[Typed, ...]) -> list[Typed]:
    """args as lists of one kind of items."""
    lists = [elements(a) for a in args]
    kinds = {a.item for a in lists if not (a.is_const and not a.const[1])}
    if kinds <= {"int", "number"} and len(kinds) == 2:
        return [Typed(a.col.cast("array<double>"), "list", "number") for a in lists]
    if len(kinds) > 1 or "mixed" in kinds:
        raise NotStatic("items of several kinds")
    item = next(iter(kinds), "string")
    return [Typed(a.col.cast(f"array<{SPARK_TYPES[item]}>"), "list", item) if a.item != item else a for a in lists]


def array_concat(*args: Typed) -> Typed:
    if any(a.kind == "null" for a in args):
        return NULL
    lists = alike(args)
    known = args[0].col.isNotNull()
    for a in args[1:]:
        known = known & a.col.isNotNull()
    return Typed(F.when(known, F.concat(*(a.col for a in lists))), "list", lists[0].item)


def distinct(v: Typed) -> Typed:
    if v.kind == "null":
        return NULL
    if v.kind != "list":
        return Typed(F.when(v.col.isNotNull(), F.array(v.col)), "list", v.kind)
    if v.item in ("mixed", "number", "list"):
        raise NotStatic("items that array_distinct tells apart otherwise")
    return Typed(F.array_distinct(v.col), "list", v.item)


def array_to_string(v: Typed, separator: Typed) -> Typed:
    by = string(separator)
    if "null" in (v.kind, by.kind):
        return NULL
    strings = cast(v, "list")
    return NULL if strings.kind == "null" else Typed(_join(strings.col, separator, by), "string")


def _join(strings: Column, separator: Typed, by: Typed) -> Column:
    if separator.is_const:
        return F.array_join(strings, _text(separator))
    return F.call_function("array_join", strings, by.col)


def _moment(v: Typed, kinds: tuple[str, ...]) -> Column | None:
    if v.kind in TIME:
        return v.col.cast("timestamp_ntz")
    found = [c.col.cast("timestamp_ntz") for k in kinds if (c := cast(v, k)).kind != "null"]
    return F.coalesce(*found) if found else None


def part(f: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
    def call(v: Typed) -> Typed:
        t = None if v.kind == "null" else _moment(v, ("date", "datetime"))
        return NULL if t is None else Typed(f(t).cast("bigint"), "int")

    return call


def date_diff(a: Typed, b: Typed) -> Typed:
    x, y = (None if v.kind == "null" else _moment(v, ("date",)) for v in (a, b))
    if x is None or y is None:
        return NULL
    # Whole seconds lose nothing: a day is so many of them, and the quotient goes towards zero.
    micros = F.timestamp_diff("MICROSECOND", y, x)
    return Typed((micros / F.lit(86_400_000_000)).cast("bigint"), "int")


#: name -> (fewest arguments, most arguments, function of columns). today() and all calls on constants are folded before.
LIBRARY: dict[str, tuple[int, int, Callable[..., Typed]]] = {
    "lower": (1, 1, _strings("string")(F.lower)),
    "upper": (1, 1, _strings("string")(upper)),
    "length": (1, 1, _strings("int")(lambda s: F.length(s).cast("bigint"))),
    "substr": (2, 3, substr),
    "starts_with": (2, 2, _strings("bool")(lambda s, t: s.startswith(t))),
    "ends_with": (2, 2, _strings("bool")(lambda s, t: s.endswith(t))),
    "contains_substr": (2, 2, _strings("bool")(lambda s, t: s.contains(t))),
    "trim": (1, 2, trimmed(F.btrim)),
    "ltrim": (1, 2, trimmed(lambda s, c: F.ltrim(s, c))),
    "rtrim": (1, 2, trimmed(lambda s, c: F.rtrim(s, c))),
    "replace": (3, 3, replace),
    "split": (2, 2, split),
    "concat": (2, ANY_NUMBER, _strings("string")(F.concat)),
    "regexp_contains": (2, 2, regexp_contains),
    "regexp_extract": (2, 2, regexp_extract),
    "to_string": (1, 1, string),
    "abs": (1, 1, absolute),
    "ceil": (1, 1, whole(F.ceil)),
    "floor": (1, 1, whole(F.floor)),
    "round": (1, 2, rounded),
    "mod": (2, 2, mod),
    "sqrt": (1, 1, numbers(F.sqrt)),
    "pow": (2, 2, numbers(F.pow)),
    "greatest": (1, ANY_NUMBER, extreme(F.greatest)),
    "least": (1, ANY_NUMBER, extreme(F.least)),
    "coalesce": (0, ANY_NUMBER, coalesce),
    "array_length": (1, 1, array_length),
    "array_contains": (2, 2, array_contains),
    "array_concat": (1, ANY_NUMBER, array_concat),
    "distinct": (1, 1, distinct),
    "array_to_string": (2, 2, array_to_string),
    "year": (1, 1, part(F.year)),
    "month": (1, 1, part(F.month)),
    "day": (1, 1, part(F.dayofmonth)),
    "date_diff": (2, 2, date_diff),
}
