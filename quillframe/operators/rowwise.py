"""Statements whose expressions have no static kind: the evaluator for single values, in Arrow batches.

apply() is also what runs mutations on the rows of documents.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NotStatic
from ..functions.values import CastError, Value, cast, contains, evaluate, format_value, from_python, items_of, order, to_python, truthy
from ..plans.nodes import Assign, Drop, Expr, Select, Statement, Update, column_name
from .compiler import Compiler


def sort_parts(v: Value) -> dict:
    """A value as a struct that Spark sorts as the dialect does within one kind, and by text otherwise."""
    if v is None:
        return {"rank": 3, "number": 0.0, "time": 0, "text": ""}
    if v[0] in ("int", "number", "bool"):
        return {"rank": 0, "number": float(v[1]), "time": 0, "text": ""}
    if v[0] in ("date", "datetime"):
        t = v[1].replace(tzinfo=None)
        return {"rank": 1, "number": 0.0, "time": (t.toordinal() * 86_400 + t.hour * 3600 + t.minute * 60 + t.second) * 1_000_000 + t.microsecond, "text": ""}
    return {"rank": 2, "number": 0.0, "time": 0, "text": format_value(v)}


SORT_TYPE = pa.struct([("rank", pa.int32()), ("number", pa.float64()), ("time", pa.int64()), ("text", pa.string())])
SORT_DDL = "struct<rank: int, number: double, time: bigint, text: string>"

ERROR = "_error"

#: Sorting values in one place, for callers that hold them all.
by_order = functools.cmp_to_key(order)


#: Kinds that stay as they are, in Arrow's types and Spark's.
KINDS = {"int": (pa.int64(), "bigint"), "number": (pa.float64(), "double"), "bool": (pa.bool_(), "boolean")}
TEXT = (pa.string(), "string")


def static_kind(df: DataFrame, e: Expr) -> str | None:
    try:
        return Compiler(df.schema).value(e).kind
    except NotStatic:
        return None


def select(df: DataFrame, q: Select) -> DataFrame:
    """Filter, sort, limit and project. Columns whose kind is known keep its type; the others are text."""
    names = [column_name(e, i) for i, e in enumerate(q.columns)]
    kinds = [static_kind(df, e) for e in q.columns]
    sources = df.columns

    def run(batches):
        for batch in batches:
            cells, keys = [[] for _ in names], [[] for _ in q.sort]
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(sources, values))
                if q.where is not None and not truthy(evaluate(q.where, row)):
                    continue
                for out, e, kind in zip(cells, q.columns, kinds):
                    v = evaluate(e, row)
                    out.append(None if v is None else v[1] if v[0] == kind else format_value(v))
                for out, t in zip(keys, q.sort):
                    out.append(sort_parts(evaluate(t.expr, row)))
            columns = [pa.array(c, KINDS.get(k, TEXT)[0]) for c, k in zip(cells, kinds)] + [pa.array(k, SORT_TYPE) for k in keys]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(names))] + [f"k{i}" for i in range(len(q.sort))])

    ddl = [f"c{i} {KINDS.get(k, TEXT)[1]}" for i, k in enumerate(kinds)] + [f"k{i} {SORT_DDL}" for i in range(len(q.sort))]
    out = df.mapInArrow(run, ", ".join(ddl))
    if q.sort:
        out = out.orderBy(*(F.col(f"k{i}").desc() if t.descending else F.col(f"k{i}").asc() for i, t in enumerate(q.sort)))
    if q.limit:
        out = out.limit(q.limit)
    return out.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


class RowError(ValueError):
    """A statement can't be applied to a row."""


# -- statements on one row; a row is a dict and is changed in place

def apply(q: Statement, row: dict, strict: bool = False) -> bool:
    """Run a mutation on row; whether row matched."""
    if q.where is not None and not truthy(evaluate(q.where, row)):
        return False
    if isinstance(q, Update):
        for a in q.assigns:
            assign(a, row)
    elif isinstance(q, Drop):
        for f in q.fields:
            row.pop(f.name, None)
    else:
        for old, new in q.pairs:
            if old in row and (old != new or strict):
                value = row.pop(old)
                if old != new:
                    row[new] = value
    return True


def assign(a: Assign, row: dict) -> None:
    name, kind = a.target.name, a.target.kind
    if a.value is None:
        if name not in row:
            row[name] = None
        elif kind != "any":
            row[name] = to_python(_cast(from_python(row[name]), kind, f'cannot cast field "{name}"'))
        return
    value = evaluate(a.value, row)
    if kind != "any":
        value = _cast(value, kind, f'cannot cast value to {kind} for field "{name}"')
    if a.op == "=":
        row[name] = to_python(value)
        return
    given = [None] if value is None else items_of(value)
    held = row.get(name)
    if a.op == "+=":
        items = list(held) if isinstance(held, list) else [] if held is None else [held]
        for v in given:
            if not contains([from_python(x) for x in items], v):
                items.append(to_python(v))
        row[name] = items
    elif isinstance(held, list):
        row[name] = [x for x in held if not contains(given, from_python(x))]


def _cast(value, kind: str, what: str):
    try:
        return cast(value, kind)
    except CastError as e:
        raise RowError(f"{what}: {e}") from None


def mutate(df: DataFrame, q: Statement) -> DataFrame:
    """df after an UPDATE or ALTER. Columns that it sets become text, the others stay; failed rows as in statements.mutate."""
    columns = df.columns
    if isinstance(q, Update):
        touched = [a.target.name for a in q.assigns]
    else:
        touched = [f.name for f in q.fields] if isinstance(q, Drop) else [n for pair in q.pairs for n in pair]
    touched = list(dict.fromkeys(touched))
    kept_names = [c for c in columns if c not in touched and c != ERROR]
    keys = T.StructType([df.schema[c] for c in kept_names] + [T.StructField(c, T.StringType()) for c in [*touched, ERROR]])
    arrow = [None] * len(kept_names) + [pa.string()] * (len(touched) + 1)

    def run(batches):
        for batch in batches:
            texts: list[list] = [[] for _ in range(len(touched) + 1)]
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(columns, values))
                why = row.pop(ERROR, None)
                before = dict(row)
                try:
                    if why is None:
                        apply(q, row)
                except RowError as e:
                    row, why = before, str(e)
                for out, name in zip(texts, touched):
                    v = from_python(row.get(name))
                    out.append(None if v is None else format_value(v))
                texts[-1].append(why)
            arrays = [batch.column(c) for c in kept_names] + [pa.array(t, k) for t, k in zip(texts, arrow[len(kept_names) :])]
            yield pa.RecordBatch.from_arrays(arrays, names=keys.names)

    return df.mapInArrow(run, keys)
