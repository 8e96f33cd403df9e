"""SimHash near-duplicates: covering masks find the candidates, links are exact, components span the corpus.

The 64 bit positions get non-zero vectors of GF(2)^(radius+1), and every
non-zero vector v makes a table whose key keeps the bits with odd product with
v. Any `radius` positions leave some v orthogonal to all of them, so two
fingerprints within the radius agree on all bits of some table: no pair is
missed. All work is on distinct fingerprints, so exact copies cost nothing.

A bucket of a few fingerprints is compared pair by pair. A large one (a great
group of near copies) is not: there, each fingerprint is joined to the points
that differ from it in at most one of the bits the table leaves open. Two
fingerprints are within two bits exactly if they share such a point, so linking
each point's fingerprints to the smallest gives the same components with work
in proportion to the bucket.

Defined results: a null or wordless text has fingerprint zero and is linked
like any other; repeated rows are rows of one class; a null doc_id takes part
but never names a component unless it has no other; an empty table gives no
rows. Other columns are not read by components() and are kept by keep_one().
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, join_spread, materialise, table, unused

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Buckets of more distinct fingerprints are linked through shared points instead of pairs.
LARGE_BUCKET = 24
#: Edges that one task contracts at once, at most about.
LOCAL_EDGES = 500_000


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of text, unsigned."""
    # On bytes, lower() and split() know exactly A-Z and the six ASCII white-space characters.
    words = (text or "").encode(errors="replace").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(hashes))))


def masks(radius: int = RADIUS, seed: int = 11) -> list[int]:
    """2**(radius+1) - 1 masks of kept bits; for any `radius` positions, one mask keeps none of them."""
    size = radius + 1
    vectors = list(range(1, 1 << size))
    dealt = (vectors * (64 // len(vectors) + 1))[:64]
    random.Random(seed).shuffle(dealt)
    return [sum(1 << i for i, a in enumerate(dealt) if bin(a & v).count("1") % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint's bits as a long."""

    def run(batches):
        for batch in batches:
            fps = [_signed(fingerprint(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fps, pa.int64())})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b), a < b, among distinct fingerprints fp, whose components are those of all pairs within RADIUS, and the tables that they are read from."""
    tables = masks()
    rows = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for t, m in enumerate(tables)])).alias("b")).select("fp", "b.*")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("size"), F.min("fp").alias("least"), F.max("fp").alias("most")).filter("size > 1")
    # A bucket of two is its least and its greatest: no join is needed.
    close = F.bit_count(F.col("least").bitwiseXOR(F.col("most"))) <= RADIUS
    sizes = materialise(sizes, "simhash-buckets")
    twos = sizes.filter("size = 2").filter(close).select(F.col("least").alias("a"), F.col("most").alias("b"))
    shared = rows.join(sizes.filter("size > 2").select("t", "key", "size"), ["t", "key"])
    shared = materialise(shared, "simhash-shared")
    some = shared.filter(F.col("size") <= LARGE_BUCKET)
    pairs = some.alias("x").join(some.alias("y"), ["t", "key"]).filter((F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS))
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = shared.filter(F.col("size") > LARGE_BUCKET)
    open_bits = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in tables])
    points = many.select("t", "fp", F.explode(F.element_at(open_bits, F.col("t").cast("int") + 1)).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point"))
    points = points.distinct()
    centres = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = points.join(centres.select("point", "a"), "point").filter(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return twos.union(pairs).union(stars).distinct(), [sizes, shared]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, with the components of edges: of each LOCAL_EDGES edges of a partition, one to each node from its component's least."""

    def run(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def stars():
            found = [(find(x), x) for x in list(parent)]
            found = [e for e in found if e[0] != e[1]]
            parent.clear()
            for i in range(0, len(found), 10_000):
                a, b = zip(*found[i : i + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        seen = 0
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
            seen += batch.num_rows
            if seen + batch.num_rows > LOCAL_EDGES:
                yield from stars()
                seen = 0
        yield from stars()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), a < b, as a table: root is the smallest node of its component.

    Pieces of at most about LOCAL_EDGES edges are first contracted to stars by
    one task each. One piece's stars are the result; the stars of several go
    through large-star and small-star steps in turn, which keep components and
    shorten paths, so few rounds are needed however long a chain is.
    """
    edges = materialise(edges.select("a", "b"), "edges")
    one = edges.count() <= LOCAL_EDGES // 2
    old, edges = edges, materialise(contracted(edges.coalesce(1) if one else edges), "contracted")
    forget(old)
    before = None
    while not one:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: a node's greater neighbours go to its least neighbour (or itself).
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        large = materialise(large, "large-star")
        # Small star: a node and its smaller neighbours go to the least of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.select(F.col("m").alias("a"), "b").union(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a < b").distinct()
        old, edges = edges, materialise(small, "small-star")
        forget(old, large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
    roots = materialise(roots, "roots")
    forget(edges)
    return roots


def classes(hashed: DataFrame) -> DataFrame:
    """(fp, component_id, n) for each distinct fp of hashed (doc_id, fp), n being its rows; a table."""
    distinct = materialise(hashed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    edges, tables = links(distinct.select("fp"))
    roots = connected(edges)
    forget(*tables)
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "simhash-named")
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialise(named.join(component, "root").select("fp", "component_id", "n"), "simhash-classes")
    forget(distinct, roots, named)
    return found


def components(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of documents."""
    hashed = materialise(fingerprints(documents), "simhash-hashed")
    return join_spread(hashed, classes(hashed), ["fp"], "n").select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def _hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(documents: DataFrame) -> DataFrame:
    """documents with one row of each component: that of the smallest doc_id, and one of its repeats."""
    names = documents.columns
    row, fp = unused(documents, "__row", "__fp")
    numbered = T.StructType([*documents.schema.fields, T.StructField(row, T.LongType()), T.StructField(fp, T.LongType())])

    def run(batches):
        for batch in batches:
            fps = [_signed(fingerprint(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], names=[*names, row, fp])

    # The numbers are part of the written table, so they stay the same however often it is read.
    marked = materialise(documents.withColumn(row, F.monotonically_increasing_id()).mapInArrow(run, numbered), "simhash-rows")
    ids = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("at"))
    first = join_spread(ids, classes(ids.select("doc_id", "fp")), ["fp"], "n")
    # Components without any doc_id are told apart by fingerprint.
    kept = first.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at")).alias("m"))
    return marked.join(kept.select(F.col("m.at").alias(row)), row, "left_semi").select(*names)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
