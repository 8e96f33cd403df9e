"""SELECT, UPDATE and ALTER over a table: DataFrame in, DataFrame out."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import SPARK_TYPES, NotStatic, Typed, cast, column, elements, item, kind_of_type, one_of, string
from ..plans.nodes import Assign, Drop, Rename, Select, Statement, Update, column_name
from .compiler import Compiler, shown, sort_key

ERROR = "_error"
#: SELECT * shows at most this many columns unless told otherwise; 0: all.
MAX_COLUMNS = 20


@contextmanager
def legacy(spark: SparkSession):
    """ANSI mode off while expressions are analysed: 64-bit arithmetic wraps, nothing throws. The user's setting comes back."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def select(df: DataFrame, q: Select, tie_break: tuple[Column, ...] = (), max_columns: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Filter, sort, limit and project. keep: columns that come first whatever is projected.

    Sorting is stable where tie_break orders the input rows.
    """
    hidden = {c for c in keep if c in df.columns}
    c = Compiler(_visible(df.schema, hidden))
    with legacy(df.sparkSession):
        out = df if q.where is None else df.filter(c.condition(q.where))
        if q.sort:
            keys = [_direction(sort_key(c.value(t.expr)), t.descending) for t in q.sort]
            out = out.orderBy(*keys, *tie_break)
        if q.limit:
            out = out.limit(q.limit)
        first = [F.col(f"`{k}`") for k in keep]
        return out.select(*first, *_projection(c, q, max_columns))


def _visible(schema, hidden):
    return type(schema)([f for f in schema.fields if f.name not in hidden])


def _projection(c: Compiler, q: Select, max_columns: int) -> list[Column]:
    if q.star:
        names = sorted(c.types, key=lambda n: n.encode())[: max_columns or None]
        return [column(n, c.types[n]).as_type().alias(n) for n in names]
    names = [column_name(e, i) for i, e in enumerate(q.columns)]
    return [c.value(e).as_type().alias(n) for e, n in zip(q.columns, names)]


def _direction(key: Column, descending: bool) -> Column:
    # Nulls are greatest, so they come last upwards and first downwards.
    return key.desc_nulls_first() if descending else key.asc_nulls_last()


def mutate(df: DataFrame, q: Statement) -> DataFrame:
    """df after an UPDATE or ALTER. A row whose assignment fails stays as it was, with the reason in _error."""
    with legacy(df.sparkSession):
        if isinstance(q, Update):
            return update(df, q)
        return drop(df, q) if isinstance(q, Drop) else rename(df, q)


def update(df: DataFrame, q: Update) -> DataFrame:
    hit = F.lit(True) if q.where is None else F.coalesce(Compiler(df.schema).condition(q.where), F.lit(False))
    checked = any(a.target.kind != "any" for a in q.assigns)
    names, originals = df.columns, [F.col(f"`{c}`") for c in df.columns]
    state = df.select(*originals, F.struct(*originals).alias("__before"), hit.alias("__hit"), F.lit(None).cast("string").alias("__why"))
    if ERROR in names:
        state = state.withColumn("__hit", F.col("__hit") & F.col(ERROR).isNull())
    for a in q.assigns:
        state = _assign(state, a)
    before = {f.name: f.dataType for f in df.schema.fields}
    failed = F.col("__why").isNotNull()
    out = []
    for f in state.schema.fields:
        if f.name.startswith("__") or f.name == ERROR:
            continue
        now = F.col(f"`{f.name}`")
        if checked:
            old = _as(F.col("__before")[f.name], before[f.name], f.dataType) if f.name in before else F.lit(None).cast(f.dataType)
            now = F.when(failed, old).otherwise(now)
        out.append(now.alias(f.name))
    if checked or ERROR in names:
        out.append(F.coalesce(F.col("__why"), F.col(ERROR) if ERROR in names else F.lit(None)).alias(ERROR))
    return state.select(*out)


def _as(x: Column, was: T.DataType, now: T.DataType) -> Column:
    """A column's former values in the type that it has now: the same, or as text, or as a list."""
    if was == now:
        return x
    kind, item_kind = kind_of_type(was)
    old = Typed(x.cast("timestamp_ntz") if kind == "temporal" else x, kind, item_kind)
    if isinstance(now, T.ArrayType):
        return F.when(x.isNotNull(), strings(elements(old)).col).cast(now)
    return shown(old) if isinstance(now, T.StringType) else x.cast(now)


def strings(t: Typed) -> Typed:
    """A list with its items as text; null items stay."""
    return t if t.item == "string" else Typed(F.transform(t.col, lambda x: string(item(x, t.item)).col), "list", "string")


def _assign(state: DataFrame, a: Assign) -> DataFrame:
    name = a.target.name
    fields = {f.name: f.dataType for f in state.schema.fields if not f.name.startswith("__")}
    c = Compiler(_visible(state.schema, {"__before", "__hit", "__why", ERROR}))
    old = column(name, fields[name]) if name in fields else None
    why = F.col("__why")
    on = F.col("__hit") & why.isNull()
    if a.value is None:
        if old is None:
            return state.withColumn(name, F.lit(None).cast("string"))
        new = cast(old, a.target.kind)
        text, cause = f'cannot cast field "{name}" to {a.target.kind}', True
    else:
        given = c.value(a.value)
        new = given if a.op == "=" or a.target.kind == "any" else cast(given, a.target.kind)
        if a.op == "=":
            new = cast(given, a.target.kind)
        text, cause = f'cannot cast value to {a.target.kind} for field "{name}"', True
    if a.target.kind != "any" and cause:
        bad = on & new.col.isNull()
        state = state.withColumn("__why", F.when(bad, F.lit(text)).otherwise(why))
        on = F.col("__hit") & F.col("__why").isNull()
    if a.op == "+=" and a.value is not None:
        new = _added(old, new)
    elif a.op == "-=" and a.value is not None:
        if old is None or old.kind != "list":
            return state
        new = _removed(old, new)
    return state.withColumn(name, _blend(on, new, old))


def _blend(on: Column, new: Typed, old: Typed | None) -> Column:
    """new where on holds, else old, in a type that fits both."""
    if old is None:
        return F.when(on, new.as_type())
    if (new.kind, new.item) == (old.kind, old.item) or old.kind == "null":
        return F.when(on, new.as_type()).otherwise(old.as_type() if old.kind != "null" else F.lit(None))
    if new.kind == "null":
        return F.when(on, F.lit(None)).otherwise(old.as_type())
    if {new.kind, old.kind} <= {"int", "number"}:
        return F.when(on, cast(new, "number").col).otherwise(cast(old, "number").col)
    if {new.kind, old.kind} <= {"date", "datetime", "temporal"}:
        return F.when(on, new.col.cast("timestamp_ntz")).otherwise(old.col.cast("timestamp_ntz"))
    if new.kind == "list" and new.item != "mixed":
        return F.when(on, strings(new).col).when(old.col.isNotNull(), strings(elements(old)).col)
    # A table column has one type: what differs in kind is kept as text.
    return F.when(on, shown(new)).otherwise(shown(old))


def _added(old: Typed | None, new: Typed) -> Typed:
    items = elements(new)
    if items.item == "mixed":
        raise NotStatic("a list of several kinds")
    if new.kind == "null":
        kind = elements(old).item if old is not None and old.kind != "null" else "string"
        items = Typed(F.array(F.lit(None).cast(SPARK_TYPES[kind])), "list", kind)
    if old is None or old.kind == "null":
        start = Typed(F.array().cast(f"array<{SPARK_TYPES[items.item]}>"), "list", items.item)
    else:
        start = elements(old)
        empty = F.array().cast(f"array<{SPARK_TYPES[start.item]}>")
        start = Typed(F.when(old.col.isNull(), empty).otherwise(start.col), "list", start.item)
    if new.kind == "list":
        items = Typed(F.coalesce(items.col, F.array(F.lit(None)).cast(f"array<{SPARK_TYPES[items.item]}>")), "list", items.item)

    def held(x: Column, among: Typed) -> Column:
        return F.when(x.isNull(), F.exists(among.col, lambda y: y.isNull())).otherwise(one_of(item(x, items.item), among))

    fresh = F.filter(items.col, lambda x: ~held(x, start))
    nothing = F.array().cast(f"array<{SPARK_TYPES[items.item]}>")
    fresh = F.aggregate(fresh, nothing, lambda acc, x: F.when(held(x, Typed(acc, "list", items.item)), acc).otherwise(F.concat(acc, F.array(x))))
    if start.item == items.item:
        return Typed(F.concat(start.col, fresh), "list", items.item)
    if {start.item, items.item} <= {"int", "number"}:
        return Typed(F.concat(start.col.cast("array<double>"), fresh.cast("array<double>")), "list", "number")
    return Typed(F.concat(strings(start).col, strings(Typed(fresh, "list", items.item)).col), "list", "string")


def _removed(old: Typed, new: Typed) -> Typed:
    items = elements(new)
    gone = (lambda x: x.isNull()) if new.kind == "null" else lambda x: F.when(x.isNull(), F.exists(items.col, lambda y: y.isNull()) if items.item != "mixed" else F.lit(False)).otherwise(one_of(item(x, old.item), items))
    return Typed(F.filter(old.col, lambda x: ~gone(x)), "list", old.item)


def _hit(df: DataFrame, where) -> Column | None:
    hit = None if where is None else F.coalesce(Compiler(df.schema).condition(where), F.lit(False))
    if ERROR in df.columns:
        healthy = F.col(ERROR).isNull()
        hit = healthy if hit is None else hit & healthy
    return hit


def drop(df: DataFrame, q: Drop) -> DataFrame:
    """Columns go; with WHERE, they go only from matching rows, where null stands for what is missing."""
    names = [f.name for f in q.fields]
    hit = _hit(df, q.where)
    if hit is None:
        return df.drop(*[F.col(f"`{n}`") for n in names if n in df.columns])
    gone = set(names) & set(df.columns)
    return df.select(*[F.when(~hit, F.col(f"`{c}`")).alias(c) if c in gone else F.col(f"`{c}`") for c in df.columns])


def rename(df: DataFrame, q: Rename) -> DataFrame:
    """Pairs apply in order; a new name that exists is overwritten, and a missing old name changes nothing."""
    hit = _hit(df, q.where)
    out = df if hit is None else df.withColumn("__hit", hit)
    for old, new in q.pairs:
        if old not in out.columns or old == new:
            continue
        if hit is None:
            out = (out.drop(F.col(f"`{new}`")) if new in out.columns else out).withColumnRenamed(old, new)
            continue
        on, types = F.col("__hit"), out.schema
        a = column(old, types[old].dataType)
        b = column(new, types[new].dataType) if new in out.columns else None
        out = out.withColumn(new, _blend(on, a, b)).withColumn(old, F.when(~on, F.col(f"`{old}`")))
    return out if hit is None else out.drop("__hit")
