"""Expressions as columns.

Every sub-expression without a field is worked out once, by the evaluator for
single values. The rest becomes native expressions by the static kinds of the
fields; NotStatic says that an expression has none, and the statement is then
evaluated row by row (see operators.rowwise).

value() never leaves the meaning of the dialect: its booleans are never null.
condition() is for WHERE, where null and false are the same: there comparisons
stay bare, so that Spark can push them into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns
from ..functions.columns import NULL, NUMERIC, SPARK_TYPES, TEXT, TIME, NotStatic, Typed, cast, column, constant, elements, equal_values, item, not_nan, number, one_of, same_list, string, truthy
from ..functions.library import LIBRARY, alike
from ..functions.values import FUNCTIONS, evaluate, format_value, try_cast
from ..plans.nodes import Binary, Call, Expr, Field, ListOf, Literal, Unary

COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")


def constant_only(e: Expr) -> bool:
    if isinstance(e, Field):
        return False
    parts = {Literal: lambda: (), ListOf: lambda: e.items, Unary: lambda: (e.operand,), Binary: lambda: (e.left, e.right), Call: lambda: e.args}[type(e)]()
    return all(map(constant_only, parts))


class Compiler:
    """Compiles over the columns of one schema."""

    def __init__(self, schema: T.StructType):
        self.types = {f.name: f.dataType for f in schema.fields}

    # -- values

    def value(self, e: Expr) -> Typed:
        if constant_only(e):
            return constant(evaluate(e, {}))
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def _field(self, e: Field) -> Typed:
        if e.name not in self.types:
            return NULL
        return cast(column(e.name, self.types[e.name]), e.kind)

    def _listof(self, e: ListOf) -> Typed:
        items = [self.value(x) for x in e.items]
        if any(i.kind == "list" for i in items):
            raise NotStatic("a list in a list")
        known = tuple(i for i in items if i.kind != "null")
        kind = (lists := alike(known))[0].item if known else "string"
        nothing = F.array(F.lit(None).cast(SPARK_TYPES[kind]))
        rest = iter(lists if known else ())
        return Typed(F.concat(*(nothing if i.kind == "null" else next(rest).col for i in items)), "list", kind)

    def _unary(self, e: Unary) -> Typed:
        if e.op == "not":
            return Typed(~self.truth(e.operand), "bool")
        v = self.value(e.operand)
        return Typed(-v.col, v.kind) if v.kind in ("int", "number") else NULL

    def _binary(self, e: Binary) -> Typed:
        if e.op in ("and", "or"):
            a, b = self.truth(e.left), self.truth(e.right)
            return Typed(a & b if e.op == "and" else a | b, "bool")
        a, b = self.value(e.left), self.value(e.right)
        if e.op in COMPARISONS:
            return Typed(compared(e.op, a, b), "bool")
        if e.op in ("<=>", ">=<"):
            return set_operation(e.op, a, b)
        if e.op in ("+", "-", "*", "/"):
            return arithmetic(e.op, a, b)
        return matched(e.op, a, b)

    def _call(self, e: Call) -> Typed:
        if e.name == "today":
            return constant(FUNCTIONS["today"][2]())
        found = LIBRARY.get(e.name)
        if found is None or not found[0] <= len(e.args) <= found[1]:
            return NULL
        return found[2](*(self.value(a) for a in e.args))

    def truth(self, e: Expr) -> Column:
        """Truth of e, never null."""
        return truthy(self.value(e))

    # -- conditions

    def condition(self, e: Expr) -> Column:
        """Truth of e where null means false."""
        if isinstance(e, Binary) and not constant_only(e):
            if e.op in ("and", "or"):
                a, b = self.condition(e.left), self.condition(e.right)
                return a & b if e.op == "and" else a | b
            if e.op in COMPARISONS:
                return bare(e.op, self.value(e.left), self.value(e.right))
        v = self.value(e)
        return v.col if v.kind == "bool" else truthy(v)


def compared(op: str, a: Typed, b: Typed) -> Column:
    """A comparison, never null: null equals null and nothing else."""
    if a.kind == "null" or b.kind == "null":
        if op not in ("=", "!="):
            # Two nulls: only "=" holds; one null: only "!=" does.
            return F.lit(False)
        other = b if a.kind == "null" else a
        is_null = F.lit(True) if other.kind == "null" else F.lit(False) if other.item == "mixed" else other.col.isNull()
        return is_null if op == "=" else ~is_null
    if a.kind == "list" or b.kind == "list":
        return compared_lists(op, a, b)
    if op == "=":
        if a.kind == b.kind and (a.kind != "number" or a.is_const or b.is_const):
            return a.col.eqNullSafe(b.col)
        return (a.col.isNull() & b.col.isNull()) | F.coalesce(equal_values(a, b), F.lit(False))
    if op == "!=":
        return ~compared("=", a, b)
    return F.coalesce(ordered(op, a, b), F.lit(False))


def ordered(op: str, a: Typed, b: Typed) -> Column:
    """An ordering of numbers, null where either side is none."""
    if a.kind in TIME + ("link", "mdlink") or b.kind in TIME + ("link", "mdlink"):
        return F.lit(False)
    if {a.kind, b.kind} <= {"int"}:
        x, y = a, b
    else:
        x, y = number(a), number(b)
    if "null" in (x.kind, y.kind):
        return F.lit(False)
    test = {"<": x.col < y.col, "<=": x.col <= y.col, ">": x.col > y.col, ">=": x.col >= y.col}[op]
    # Spark puts NaN above all numbers; here it compares with none.
    guard = not_nan(x if a.kind in ("number", "string") else NULL, y if b.kind in ("number", "string") else NULL)
    if a.kind == b.kind == "number" or a.is_const or b.is_const:
        high = x if op in (">", ">=") else y
        low = y if op in (">", ">=") else x
        guard = not_nan(high) if low.is_const or high.is_const else guard
    return test if guard is None else test & guard


def bare(op: str, a: Typed, b: Typed) -> Column:
    """A comparison for WHERE: null may stand for false, and sides stay as they are."""
    scalar = "list" not in (a.kind, b.kind) and "null" not in (a.kind, b.kind)
    if op not in ("=", "!=") and scalar:
        return ordered(op, a, b)
    if op == "=" and scalar and a.is_const != b.is_const:
        plain = a.kind == b.kind or a.kind in NUMERIC and b.kind in NUMERIC
        if plain and a.kind not in TIME:
            return _same(a, b)
        return equal_values(a, b)
    return compared(op, a, b)


def _same(a: Typed, b: Typed) -> Column:
    """Equality of a column and a constant of like kinds; the constant takes the column's type, so that the scan can use it."""
    if a.is_const:
        a, b = b, a
    as_a = try_cast(b.const, a.kind)
    if as_a is None or try_cast(as_a, "number") != try_cast(b.const, "number"):
        return equal_values(a, b)
    return a.col == constant(as_a).col


def compared_lists(op: str, a: Typed, b: Typed) -> Column:
    known = [t.col.isNotNull() for t in (a, b) if t.item != "mixed"]
    both = known[0] & known[1] if len(known) == 2 else known[0] if known else F.lit(True)
    if a.kind == b.kind:
        if op not in ("=", "!="):
            return F.lit(False)
        if "mixed" in (a.item, b.item):
            raise NotStatic("a list of several kinds")
        same = (a.col.isNull() & b.col.isNull()) | F.coalesce(both & same_list(a, b), F.lit(False))
        return same if op == "=" else ~same
    one, items = (b, a) if a.kind == "list" else (a, b)
    if op == "!=":
        # With a null on one side only, "!=" holds; with a list and a scalar, nothing does.
        either = F.lit(False)
        for t in (a, b):
            if t.item != "mixed":
                either = either | t.col.isNull()
        return either & ~(one.col.isNull() & (F.lit(False) if items.item == "mixed" else items.col.isNull()))
    if op == "=":
        return one.col.isNull() & (F.lit(False) if items.item == "mixed" else items.col.isNull())
    if op == (">=" if a.kind == "list" else "<="):
        return F.coalesce(both & one_of(one, items), F.lit(False))
    return F.lit(False)


def set_operation(op: str, a: Typed, b: Typed) -> Typed:
    if "null" in (a.kind, b.kind):
        return NULL
    x, y = elements(a), elements(b)
    if x.item == "mixed":
        raise NotStatic("a list of several kinds")
    known = a.col.isNotNull() if y.item == "mixed" else a.col.isNotNull() & b.col.isNotNull()
    if op == "<=>":
        return Typed(F.when(known, F.filter(x.col, lambda v: one_of(item(v, x.item), y))), "list", x.item)
    x, y = alike((x, y))
    if x.item in ("number", "list"):
        raise NotStatic("items that array_distinct tells apart otherwise")
    more = F.array_distinct(F.filter(y.col, lambda v: ~one_of(item(v, y.item), Typed(x.col, "list", x.item))))
    return Typed(F.when(known, F.concat(x.col, more)), "list", x.item)


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if a.kind == b.kind == "int":
        if op == "/":
            return Typed(F.when(b.col != 0, a.col.cast("double") / b.col.cast("double")), "number")
        return Typed({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op], "int")
    x, y = number(a), number(b)
    if "null" in (x.kind, y.kind):
        return NULL
    if op == "/":
        return Typed(F.when(y.col != 0, x.col / y.col), "number")
    return Typed({"+": x.col + y.col, "-": x.col - y.col, "*": x.col * y.col}[op], "number")


def matched(op: str, a: Typed, b: Typed) -> Typed:
    s, p = string(a), string(b)
    if "null" in (s.kind, p.kind):
        return NULL
    if not b.is_const:
        raise NotStatic("a pattern that differs by row")
    text, kind = try_cast(b.const, "string")[1], op.removeprefix("not ")
    if kind == "regexp":
        found = patterns.translate(text)
        if found is None:
            return NULL
        test = s.col.rlike(found[0])
    else:
        test = like(s.col, text, kind == "ilike")
    return Typed(~test if op.startswith("not ") else test, "bool")


def like(s: Column, pattern: str, ignore_case: bool) -> Column:
    """LIKE without escapes, where % and _ stand for anything but a line break."""
    if not ignore_case and "_" not in pattern:
        if "%" not in pattern:
            return s == pattern
        start = pattern[:-1]
        if pattern.endswith("%") and "%" not in start and start:
            # A prefix can be pushed into the scan; the rest must not go on past a line break.
            return s.startswith(start) & ~F.substring(s, F.lit(len(start) + 1), F.length(s)).contains("\n")
    return s.rlike(patterns.like_java(pattern, ignore_case))


#: Kinds that sort as they are; others sort by their text.
SORTS = NUMERIC + TIME + TEXT


def sort_key(t: Typed) -> Column:
    if t.kind == "list":
        if t.item == "mixed":
            raise NotStatic("a list of several kinds")
        return shown(t)
    return t.col if t.kind in SORTS else F.lit(None).cast("string")


def shown(t: Typed) -> Column:
    """The text of a value in results; null for null."""
    if t.is_const:
        return F.lit(None if t.const is None else format_value(t.const)).cast("string")
    if t.kind == "list":
        items = F.transform(t.col, lambda x: F.coalesce(string(item(x, t.item)).col, F.lit("")))
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    return string(t).col
