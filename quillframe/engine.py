"""Programs over documents and over tables."""

from __future__ import annotations

import os
import sys
import tempfile
from dataclasses import dataclass, field, replace
from typing import TextIO

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import NotStatic
from .functions.values import evaluate, truthy
from .operators import rowwise, statements
from .plans.nodes import Program, Select, Statement, column_name
from .plans.parser import parse_program, parse_query
from .render import RENDERERS, Renderer, footer
from .sources import documents, stores
from .sources.documents import CHANGED, FAILED, Options, Work


#: Numbers become text in Python, which can't run inside functions over lists.
LAMBDA_WITH_PYTHON = "UNSUPPORTED_FEATURE.LAMBDA_FUNCTION_WITH_PYTHON_UDF"


# -- tables with a schema

class Tables:
    """Names after FROM as tables: of a folder of Parquet tables, of the catalog, or given as DataFrames.

    UPDATE and ALTER make a new version of a table, which later statements of
    the same object see; nothing is written until save().
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, frames: dict[str, DataFrame] | None = None):
        self.spark, self.folder, self.frames = spark, folder, dict(frames or {})
        self.files: set[str] = set()

    def read(self, name: str) -> DataFrame:
        if name not in self.frames:
            if self.folder is None:
                self.frames[name] = self.spark.table(name)
            else:
                self.frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
                self.files.add(name)
        return self.frames[name]

    def source(self, names: tuple[str, ...]) -> DataFrame:
        """The rows of all tables; a table that is named twice counts once."""
        first, *rest = dict.fromkeys(names)
        out = self.read(first)
        for name in rest:
            out = out.unionByName(self.read(name), allowMissingColumns=True)
        return out

    def tie_break(self, names: tuple[str, ...]) -> tuple[Column, ...]:
        """The order of a file's rows, for stable sorting of tables that are still as they were read."""
        self.source(names)
        return (F.col("_metadata.file_path"), F.col("_metadata.row_index")) if len(set(names)) == 1 and names[0] in self.files else ()

    def query(self, text: str, max_columns: int = 0, stable: bool = False) -> DataFrame:
        """The DataFrame of one SELECT. stable: rows that sort alike keep the order of the file."""
        q = parse_query(text)
        if not isinstance(q, Select):
            raise ValueError("query() is for select; use run()")
        return self.select(q, max_columns, stable)

    def select(self, q: Select, max_columns: int = 0, stable: bool = False) -> DataFrame:
        df = self.source(q.sources)
        try:
            return statements.select(df, q, self.tie_break(q.sources) if stable and q.sort else (), max_columns)
        except NotStatic:
            pass
        except AnalysisException as e:
            if e.getCondition() != LAMBDA_WITH_PYTHON:
                raise
        return rowwise.select(df, q)

    def run(self, text: str) -> list[DataFrame]:
        """Run a program; the DataFrame of each statement, which for a mutation is the changed table."""
        return [f for q in parse_program(text).statements for f in self.statement(q)]

    def statement(self, q: Statement) -> list[DataFrame]:
        if isinstance(q, Select):
            return [self.select(q)]
        out = []
        for name in dict.fromkeys(q.sources):
            self.frames[name] = self._mutate(self.read(name), q)
            self.files.discard(name)
            out.append(self.frames[name])
        return out

    def _mutate(self, df: DataFrame, q: Statement) -> DataFrame:
        try:
            return statements.mutate(df, q)
        except (NotStatic, AnalysisException) as e:
            if isinstance(e, AnalysisException) and e.getCondition() != LAMBDA_WITH_PYTHON:
                raise
        return rowwise.mutate(df, q)

    def save(self, name: str, path: str, mode: str = "errorifexists") -> None:
        """Write a table as it is now. A failed row keeps its old values, without the column of reasons."""
        df = self.read(name)
        df.drop(statements.ERROR).write.mode(mode).parquet(path)


# -- documents

@dataclass
class Result:
    """What one statement shows."""

    headers: list[str]
    rows: list[list[str]]
    hidden: int = 0
    mutation: bool = False

    def text(self, render: Renderer) -> str:
        return render(self.headers, self.rows) + footer(len(self.rows), self.hidden, self.mutation)


@dataclass
class Outcome:
    results: list[Result] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)
    changed: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors

    def text(self, format: str = "simple") -> str:
        render = RENDERERS[format]
        return "\n".join(r.text(render) for r in self.results if r.rows or not r.mutation)


def kept(df: DataFrame) -> DataFrame:
    """df as it is now, in the folder of checkpoints, which is a new one only where none is set."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="quillframe-"))
    return df.checkpoint(eager=True)


class Records:
    """Programs over the records of a store."""

    def __init__(self, spark: SparkSession, store: stores.Store, options: Options | None = None):
        self.spark, self.store, self.options = spark, store, options or Options()

    def _plan(self, program: Program) -> Work:
        return stores.plan(program, self.store, self.options)

    def _events(self, program: Program, work: Work) -> DataFrame:
        return stores.events(self.spark, program, self.store, work, self.options)

    def _write(self, found: DataFrame) -> DataFrame:
        return stores.write(found, self.store)

    def run(self, text: str | Program) -> Outcome:
        program = parse_program(text) if isinstance(text, str) else text
        work = self._plan(program)
        out, found = Outcome(), None
        if work.paths:
            # Kept where a lost executor can't take it: records are written from it, and what was read from them before.
            found = kept(self._events(program, work))
            said = [(r.ord, r.path, r.why) for r in found.filter(F.col("statement") == FAILED).select("ord", "path", F.get("cells", F.lit(0)).alias("why")).collect()]
            if any(q.mutates for q in program.statements) and not self.options.dry_run:
                for r in self._write(found).orderBy("ord").collect():
                    if r.why is None:
                        out.changed.append(r.path)
                    else:
                        said.append((r.ord, r.path, r.why))
            out.errors = [(path, why) for _, path, why in sorted(said)]
        out.results = [self._result(found, q, i, i in work.empty) for i, q in enumerate(program.statements)]
        return out

    def _result(self, found: DataFrame | None, q: Statement, i: int, empty: bool) -> Result:
        if empty and self.options.strict and not q.mutates:
            # Evaluated once, over a record without fields and without a name.
            show = q.where is None or truthy(evaluate(q.where, {}))
            cells = documents.shown(q, {})[0] if show else []
            return Result([column_name(e, k) for k, e in enumerate(q.columns)], [cells[1::2]] if show else [])
        rows = [] if found is None else [(r.path, r.cells) for r in documents.rows_of(found, q, i).select("path", "cells").collect()]
        if isinstance(q, Select) and q.star:
            pairs = [dict(zip(cells[::2], cells[1::2])) for _, cells in rows]
            names = sorted({n for p in pairs for n in p}, key=lambda n: n.encode())
            most = self.options.max_columns
            hidden = max(0, len(names) - most) if most > 0 else 0
            names = names[: len(names) - hidden]
            return Result(["filename", *names], [[path, *(p.get(n, "") for n in names)] for (path, _), p in zip(rows, pairs)], hidden)
        headers = ["filename", *(column_name(e, k) for k, e in enumerate(q.columns))]
        return Result(headers, [[path, *cells[1::2]] for path, cells in rows], mutation=q.mutates)


class Documents(Records):
    """Programs over text files with headers, or over a table (path, content) of such documents.

    Files are listed, read and written where paths lead from options.root. A
    table's documents are found by their paths, and what changes is not written
    but given by rendered().
    """

    def __init__(self, spark: SparkSession, options: Options | None = None, content: DataFrame | None = None):
        options = options or Options()
        # Tasks run in folders of their own, so paths start from where the caller is.
        self.options = options if options.root else replace(options, root=os.getcwd())
        self.spark, self.content = spark, content

    def _plan(self, program: Program) -> Work:
        return Work(paths=["*"]) if self.content is not None else documents.plan(program, self.options)

    def _events(self, program: Program, work: Work) -> DataFrame:
        if self.content is not None:
            return documents.table_events(program, self.content, self.options)
        return documents.events(self.spark, program, work, self.options)

    def _write(self, found: DataFrame) -> DataFrame:
        if self.content is None:
            return documents.write(found, self.options)
        return found.filter(F.col("statement") == CHANGED).select("ord", "path", F.lit(None).cast("string").alias("why"))

    def query(self, text: str, ordered: bool = True) -> DataFrame:
        """The rows of one SELECT as a DataFrame: filename, and a text column for each expression (a map of all fields for *).

        ordered: in the order of the documents where the program does not sort
        them itself; without it nothing is sorted that need not be.
        """
        q = parse_query(text)
        if not isinstance(q, Select):
            raise ValueError("query() is for select; use run() or rendered()")
        program = Program((q,))
        found = self._events(program, self._plan(program))
        if (q.sort or ordered) and not q.limit:
            found = kept(found)  # a global sort looks at its input twice, which must not be the documents
        rows = documents.rows_of(found, q, 0, ordered)
        if q.star:
            pairs = F.expr("transform(sequence(0, cast(size(cells) / 2 as int) - 1), i -> struct(cells[2 * i], cells[2 * i + 1]))")
            return rows.select(F.col("path").alias("filename"), F.when(F.size("cells") > 0, F.map_from_entries(pairs)).alias("fields"))
        return rows.select(F.col("path").alias("filename"), *(F.get("cells", F.lit(2 * i + 1)).alias(column_name(e, i)) for i, e in enumerate(q.columns)))

    def _found(self, text: str) -> DataFrame:
        """All that a program makes of the documents, changed contents included, without writing any."""
        program, options = parse_program(text), self.options
        self.options = replace(options, dry_run=False)
        try:
            return self._events(program, self._plan(program))
        finally:
            self.options = options

    def rendered(self, text: str) -> DataFrame:
        """(path, content) of the documents that a program changes, without writing any."""
        return self._found(text).filter(F.col("statement") == CHANGED).select("path", F.get("cells", F.lit(0)).alias("content"))

    def failed(self, text: str) -> DataFrame:
        """(path, why) of the documents that a program can't read, change or write."""
        return self._found(text).filter(F.col("statement") == FAILED).select("path", F.get("cells", F.lit(0)).alias("why"))

    def shown(self, text: str) -> DataFrame:
        """(statement, filename, names, cells) of all rows that a program's statements show, neither sorted nor cut."""
        rows = self._found(text).filter(F.col("statement") >= 0)
        return rows.select("statement", F.col("path").alias("filename"), F.expr("filter(cells, (x, i) -> i % 2 = 0)").alias("names"), F.expr("filter(cells, (x, i) -> i % 2 = 1)").alias("cells"))


def execute(spark: SparkSession, text: str, options: Options | None = None, format: str = "simple", out: TextIO | None = None, err: TextIO | None = None, silent: bool = False) -> bool:
    """Run a program over files and print what it shows; whether every file went well."""
    out, err = out or sys.stdout, err or sys.stderr
    result = Documents(spark, options).run(text)
    for path, why in result.errors:
        print(f"ERROR: {path}: {why}", file=err)
    if not silent:
        out.write(result.text(format))
    return result.ok
