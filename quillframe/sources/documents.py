"""Programs over text files with headers.

One pass over the files does all the work of a program: each task reads its
files, runs every statement on each in turn, and emits the rows that SELECTs
and verbose mutations show, the new content of files that changed, and errors.
Sorting and limits are Spark's, over keys that the tasks emit, so no result is
gathered before it has been cut. Files are written by a second pass over the
emitted contents: a task that runs twice writes the same bytes twice.

Files reach the tasks either as paths, which the driver lists and the tasks
open themselves (a shared file system), or as a table of (path, content), which
any Spark reader can give. There the words after FROM are conditions on path, so
nothing is listed on the driver, however many documents there are.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import evaluate, format_value, from_python, truthy
from ..operators.rowwise import SORT_DDL, SORT_TYPE, RowError, apply, sort_parts
from ..plans.nodes import Program, Select, Statement, column_name
from .headers import HeaderError, decode, parse, render
from .languages import BY_EXTENSION, EXTENSIONS, Language
from .listing import expand, is_pattern, regex

NO_HEADER = "no header; name the file explicitly or pass --lang to insert one"


def shown(q: Statement, row: dict) -> tuple[list[str | None], list[dict]]:
    """Names and texts, in turn, of what q shows of row, and its sort keys."""
    if isinstance(q, Select) and q.star:
        cells = [x for name in sorted(row, key=lambda n: n.encode()) for x in (name, format_value(from_python(row[name])))]
    else:
        cells = [x for i, e in enumerate(q.columns) for x in (column_name(e, i), format_value(evaluate(e, row)))]
    return cells, [sort_parts(evaluate(t.expr, row)) for t in q.sort] if isinstance(q, Select) else []


# -- programs on files

@dataclass(frozen=True)
class Options:
    dry_run: bool = False
    verbose: bool = False
    include_hidden: bool = False
    max_columns: int = 20
    language: Language | None = None
    root: str = ""  # folder that relative paths start from
    strict: bool = False  # also what is hardly meant: "rename a to a" drops a; sources that name nothing show one row


@dataclass
class Work:
    """Which files there are, in order, and which statements see each."""

    paths: list[str] = field(default_factory=list)
    statements: dict[str, list[int]] = field(default_factory=dict)
    explicit: set[str] = field(default_factory=set)
    empty: list[int] = field(default_factory=list)  # statements whose sources name no file

    def add(self, statement: int, found: list[str], explicit: Iterable[str]) -> None:
        self.explicit.update(explicit)
        if not found:
            self.empty.append(statement)
        for path in found:
            if path not in self.statements:
                self.paths.append(path)
            seen = self.statements.setdefault(path, [])
            if statement not in seen:
                seen.append(statement)


def plan(program: Program, options: Options) -> Work:
    work = Work()
    for i, q in enumerate(program.statements):
        found = expand(q.sources, options.include_hidden, options.language is not None, options.root)
        work.add(i, found, [w for w in q.sources if not is_pattern(w)])
    return work


#: What tasks emit. statement -1: a changed file (cells: its new content); -2: an error (cells: the message).
EVENT_TYPE = [("ord", pa.string()), ("path", pa.string()), ("statement", pa.int32()), ("cells", pa.list_(pa.string())), ("keys", pa.list_(SORT_TYPE))]
EVENT_DDL = f"ord string, path string, statement int, cells array<string>, keys array<{SORT_DDL}>"
CHANGED, FAILED = -1, -2


def run_file(program: Program, path: str, raw: bytes | None, statements: Iterable[int], explicit: bool, options: Options) -> Iterator[tuple[int, list, list]]:
    """(statement, cells, keys) of everything that a program makes of one file. raw None: to be read from path."""
    try:
        if raw is None:
            with open(os.path.join(options.root, path), "rb") as f:
                raw = f.read()
        document = parse(path, decode(raw), options.language)
    except (OSError, HeaderError) as e:
        yield FAILED, [f"could not read: {e}"], []
        return
    row = dict(document.fields)
    for event in run_statements(program, statements, row, options):
        if event[0] != CHANGED:
            yield event
        elif document.found or document.plain or options.language is not None or explicit:
            yield CHANGED, [render(document, row)], []
        else:
            yield FAILED, [f"could not write: {NO_HEADER}"], []


def run_statements(program: Program, statements: Iterable[int], row: dict, options: Options) -> list[tuple[int, list, list]]:
    """Run statements on row, which is changed in place; what they show, and CHANGED at the end if row is to be written.

    The first error ends the row: what was shown before stays, and nothing is written.
    """
    out, changed = [], False
    for i in statements:
        q = program.statements[i]
        if q.mutates:
            try:
                if not apply(q, row, options.strict):
                    continue
            except RowError as e:
                return [*out, (FAILED, [str(e)], [])]
            changed = True
            if not options.verbose:
                continue
        elif q.where is not None and not truthy(evaluate(q.where, row)):
            continue
        out.append((i, *shown(q, row)))
    return [*out, (CHANGED, [], [])] if changed and not options.dry_run else out


def rank(i: int) -> str:
    """A place in order as text that sorts alike."""
    return f"{i:012d}"


def events(spark: SparkSession, program: Program, work: Work, options: Options) -> DataFrame:
    """All that a program makes of its files, as rows of EVENT_DDL."""
    listed = [(rank(i), p, work.statements[p], p in work.explicit) for i, p in enumerate(work.paths)]
    files = spark.createDataFrame(listed, FILE_DDL)
    slots = spark.sparkContext.defaultParallelism * 2
    files = files.repartitionByRange(max(1, min(slots * 8, -(-len(listed) // 16))), "ord") if listed else files
    return _events(program, files, options)


FILE_DDL = "ord string, path string, statements array<int>, explicit boolean"


def _events(program: Program, files: DataFrame, options: Options) -> DataFrame:
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in EVENT_TYPE]
            for r in batch.to_pylist():
                for statement, cells, keys in run_file(program, r["path"], r.get("raw"), r["statements"], r["explicit"], options):
                    for column, value in zip(out, (r["ord"], r["path"], statement, cells, keys)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, EVENT_TYPE)], names=[n for n, _ in EVENT_TYPE])

    return files.mapInArrow(run, EVENT_DDL)


def table_events(program: Program, content: DataFrame, options: Options) -> DataFrame:
    """All that a program makes of the documents of a table (path, content); see events()."""
    path = F.col("path")
    words = list(dict.fromkeys(w for q in program.statements for w in q.sources))
    named = [w for w in words if not is_pattern(w)]
    tests = {w: _names(path, w, named, options) for w in words}
    none = F.lit(None).cast("int")
    seen = [F.when(_any(tests[w] for w in q.sources), F.lit(i)).otherwise(none) for i, q in enumerate(program.statements)]
    first = F.coalesce(*(F.when(tests[w], F.lit(rank(i))) for i, w in enumerate(words)))
    files = content.filter(_any(tests.values())).select(
        F.concat(first, F.lit("\0"), path).alias("ord"),
        path,
        F.array_compact(F.array(*seen)).alias("statements"),
        (path.isin(named) if named else F.lit(False)).alias("explicit"),
        F.coalesce(_needed(program, content, options).cast("binary"), F.lit(b"")).alias("raw"),
    )
    return _events(program, files, options)


#: A header on the first lines, with the line that closes it.
LEADING = r"\A---[ \t]*\r?\n(?:[^\n]*\n)*?---[ \t]*\r?(?:\n|\z)"


def _needed(program: Program, content: DataFrame, options: Options) -> Column:
    """The part of content that a program looks at: of a document that is only read, its leading header, so that texts need not leave the JVM."""
    whole = F.col("content")
    if any(q.mutates for q in program.statements) or options.language is not None or content.schema["content"].dataType != T.StringType():
        return whole
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1))
    plain = suffix.isin(sorted(e for e, x in BY_EXTENSION.items() if x.plain)) | ~suffix.isin(sorted(EXTENSIONS))
    # A text with a zero byte is an error wherever that is.
    header = F.regexp_extract(whole, LEADING, 0)
    return F.when(plain & whole.startswith("---") & ~F.contains(whole, F.lit("\0")) & (header != ""), header).otherwise(whole)


def _any(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _names(path: Column, word: str, named: list[str], options: Options) -> Column:
    """Whether a word after FROM names the document at path, by the rules of listing.expand()."""
    if not is_pattern(word):
        return path == word
    found = path.rlike(regex(word))
    name = F.substring_index(path, "/", -1)
    if "." not in word.rsplit("/", 1)[-1] and options.language is None:
        found = found & F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1))).isin(sorted(EXTENSIONS)) & name.contains(".")
    if not options.include_hidden:
        found = found & (~name.startswith(".") | (path.isin(named) if named else F.lit(False)))
    return found


def write(found: DataFrame, options: Options) -> DataFrame:
    """Write the changed files among what events() found; (ord, path, why), why is null where it went well."""
    root = options.root

    def run(batches):
        for batch in batches:
            why = []
            for path, cells in zip(batch.column("path").to_pylist(), batch.column("cells").to_pylist()):
                try:
                    with open(os.path.join(root, path), "wb") as f:
                        f.write(cells[0].encode())
                    why.append(None)
                except OSError as e:
                    why.append(f"could not write: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("path"), pa.array(why, pa.string())], names=["ord", "path", "why"])

    return found.filter(F.col("statement") == CHANGED).select("ord", "path", "cells").mapInArrow(run, "ord string, path string, why string")


def rows_of(found: DataFrame, q: Statement, i: int, ordered: bool = True) -> DataFrame:
    """(ord, path, cells) that statement i shows, sorted and cut as it says. ordered: in the order of the files also where it says nothing."""
    out = found.filter(F.col("statement") == i)
    keys = []
    if isinstance(q, Select):
        for k, t in enumerate(q.sort):
            key = F.get("keys", F.lit(k))
            # Ranks put nulls last; turned around as a whole, they come first.
            keys.append(key.desc() if t.descending else key.asc())
    limit = q.limit if isinstance(q, Select) else 0
    if ordered or keys or limit:
        out = out.orderBy(*keys, "ord")
    return out.limit(limit) if limit else out
