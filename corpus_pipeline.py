"""From raw documents to packed training sequences: five stages, each one of the corpus operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. Between stages the
result is written as Parquet and read again, so each works on all that its
predecessor kept. All but the last return the columns of documents. Once the
next stage begins, the tables behind the result of the one before are deleted.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import lines, near, packing, pii, toxicity
from quillframe.llm.common import forget, materialise, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Paths of the tables that the last stage's result is computed from.
_behind: set[str] = set()


def after_the_last(stage: Stage) -> Stage:
    """stage, which first deletes what the stage before it has left: its result has been written by now."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(*_behind)
        before = written()
        out = stage(spark, docs, sf_dir)
        _behind.clear()
        _behind.update(written() - before)
        return out

    return run


@after_the_last
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of those that came in."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.filter_toxic(docs, model)


@after_the_last
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; documents stay."""
    return lines.drop_boilerplate(docs, "source")


@after_the_last
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of op6's links (SimHash, covering masks) and of five-word shingle sets of similarity 0.8 stays."""
    return near.keep_one(docs, fingerprints=True)


@after_the_last
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; documents stay."""
    return pii.redact(docs, pii.induce(docs))


@after_the_last
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Boosted trees, simhash and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        read, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(read)
    return STAGES[-1][1](spark, docs, sf_dir)
