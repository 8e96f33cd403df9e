"""Records from anywhere: a store lists keys, and reads and writes the fields behind each.

The same programs that run over files run over a store. It is sent to the
tasks, which read its records, so it must be picklable and reach its data from
there.
"""

from __future__ import annotations

import pickle
from base64 import b64decode, b64encode
from collections.abc import Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.nodes import Program
from .documents import CHANGED, EVENT_DDL, EVENT_TYPE, FAILED, Options, Work, rank, run_statements
from .listing import is_pattern


class Store(Protocol):
    def enumerate(self, words: Iterable[str], include_hidden: bool) -> list[str]:
        """The keys that the words after FROM name, in order."""

    def read(self, key: str) -> dict:
        """The fields of one record."""

    def write(self, key: str, fields: dict) -> None:
        """Replace the fields of one record."""

    def label(self, key: str) -> str:
        """What results show as the record's name."""


def plan(program: Program, store: Store, options: Options) -> Work:
    work = Work()
    for i, q in enumerate(program.statements):
        found = store.enumerate(q.sources, options.include_hidden)
        work.add(i, found, [w for w in q.sources if not is_pattern(w)])
    return work


def events(spark: SparkSession, program: Program, store: Store, work: Work, options: Options) -> DataFrame:
    """All that a program makes of a store's records; see documents.events. What changed comes as pickled fields."""
    listed = [(rank(i), k, work.statements[k]) for i, k in enumerate(work.paths)]
    keys = spark.createDataFrame(listed, "ord string, path string, statements array<int>").repartitionByRange(max(1, min(spark.sparkContext.defaultParallelism * 16, -(-len(listed) // 16))), "ord")

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in EVENT_TYPE]
            for r in batch.to_pylist():
                try:
                    fields = dict(store.read(r["path"]))
                    made = run_statements(program, r["statements"], fields, options)
                except Exception as e:  # whatever a store raises is this record's error
                    made = [(FAILED, [f"could not read: {e}"], [])]
                for statement, cells, sort_keys in made:
                    if statement == CHANGED:
                        cells = [b64encode(pickle.dumps(fields)).decode()]
                    for column, value in zip(out, (r["ord"], store.label(r["path"]) if statement != CHANGED else r["path"], statement, cells, sort_keys)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, EVENT_TYPE)], names=[n for n, _ in EVENT_TYPE])

    return keys.mapInArrow(run, EVENT_DDL)


def write(found: DataFrame, store: Store) -> DataFrame:
    """Write the changed records among what events() found; (ord, path, why), why is null where it went well."""

    def run(batches):
        for batch in batches:
            why = []
            for key, cells in zip(batch.column("path").to_pylist(), batch.column("cells").to_pylist()):
                try:
                    store.write(key, pickle.loads(b64decode(cells[0])))  # noqa: S301  written by events()
                    why.append(None)
                except Exception as e:
                    why.append(f"could not write: {e}")
            labels = [store.label(k) for k in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("ord"), pa.array(labels, pa.string()), pa.array(why, pa.string())], names=["ord", "path", "why"])

    return found.filter(F.col("statement") == CHANGED).select("ord", "path", "cells").mapInArrow(run, "ord string, path string, why string")
