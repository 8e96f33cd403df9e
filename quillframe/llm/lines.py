"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate.

A page counts once for each different line it holds; a line's share is the
pages that hold it by the pages of the host. Lines travel as two 64-bit hashes
and are counted before and after the shuffle, so neither a hot host nor a hot
line gathers in one task. A host's boilerplate list is short by arithmetic: a
line above the ratio takes up that share of the host's line slots, so there are
at most (different lines a page) / ratio of them.

Defined results: a null text stays null and has no lines; blank lines are
always kept and never counted; a null host is a host of its own; repeated rows
are pages each; an empty table gives no rows; all columns of the input are
kept, and text (and n_chars, where there is one) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, unused

#: A line goes if it is on more than RATIO of its host's pages, and on LEAST_PAGES at least.
RATIO = 0.05
LEAST_PAGES = 10
#: A list of boilerplate up to this many bytes is sent to every task; a longer one is joined by host.
BROADCAST_BYTES = 8_000_000


def _hash(line: Column) -> Column:
    # Two hashes with different starts make chance meetings negligible at any corpus size.
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(17), line).alias("g"))


def _filled(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def boilerplate(documents: DataFrame, host: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, lines): for each host, the hashes of its boilerplate lines."""
    lines = documents.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.filter(F.split("text", "\n"), _filled))).alias("line"))
    counted = lines.select("host", _hash(F.col("line")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages"))
    total = documents.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("total"))
    # Few lines come often enough, so only they meet the totals.
    often = counted.filter(F.col("pages") >= least_pages)
    kept = often.join(total, often.host.eqNullSafe(total.host)).filter(F.col("pages") > ratio * F.col("total"))
    return kept.groupBy(often.host).agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(documents: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """documents without the boilerplate lines of their hosts."""
    names = documents.columns
    listed = materialise(boilerplate(documents, host, ratio, least_pages), "lines")
    size = listed.agg(F.coalesce(F.sum(F.size("lines") * 16 + 100), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        listed = F.broadcast(listed)
    of, gone = unused(documents, "__host", "__lines")
    listed = listed.select(F.col("host").alias(of), F.col("lines").alias(gone))
    joined = documents.join(listed, documents[host].eqNullSafe(F.col(of)), "left")
    text = F.when(F.col(gone).isNull(), documents["text"]).otherwise(
        F.array_join(F.filter(F.split(documents["text"], "\n"), lambda x: ~(_filled(x) & F.array_contains(F.col(gone), _hash(x)))), "\n")
    )
    changed = {"text": text.alias("text")}
    if "n_chars" in names:
        changed["n_chars"] = F.coalesce(F.length(text).cast(documents.schema["n_chars"].dataType), documents["n_chars"]).alias("n_chars")
    return joined.select(*[changed.get(n, documents[n]) for n in names])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents"))


OP8_SQL = rf"""
WITH pages AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
lines AS (SELECT DISTINCT doc_id, source, line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
often AS (SELECT source, line FROM (SELECT source, line, count(*) AS n FROM lines GROUP BY source, line) JOIN pages USING (source)
  WHERE n >= {LEAST_PAGES} AND n > {RATIO} * total),
kept AS (SELECT d.doc_id, string_agg(d.line, chr(10) ORDER BY d.i) AS text
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) d
  LEFT JOIN often o ON o.source = d.source AND o.line = d.line WHERE o.line IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, coalesce(k.text, '') AS text, d.lang, d.source, CAST(length(coalesce(k.text, '')) AS BIGINT) AS n_chars
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
