"""Near copies by shingle similarity: MinHash bands find the candidates, exact Jaccard similarity decides.

A text is the set of its five-word shingles (lower-cased; a text of fewer words
is one shingle), as 32-bit hashes. Equal texts are one node, so exact copies
cost nothing. Nodes that agree on all ROWS values of one of BANDS bands share a
bucket; a pair of similarity s does so with probability
1 - (1 - s**ROWS)**BANDS, which at 0.8 is 0.999995.

Components need links, not all pairs: the nodes of a bucket of over SMALL are
first held against one of them, then against CENTRES others, and only nodes of
a bucket that are in different components by then are compared pair by pair, in
parts. Every pair of a bucket ends in one component or is compared. Before the sets of
a pair meet, its sizes, its parities and PLANES bits of each minimum must allow a
similarity of 0.8. At that similarity, over DIFFER of 240 minima differ in those bits
with a probability under 1e-8. Parities are exact: a hash deals a set's shingles to
PARITIES bits, each the parity of its count, so that two sets differ in at least as
many shingles as bits. Small sets that are not near copies hardly ever pass; of sets
of thousands of shingles the minima tell more.

SimHash fingerprints can't do this alone: at a Jaccard similarity of 0.8 they differ
in about 10 of 64 bits, and covering masks for that radius are 2**11 tables. Where
fingerprints are asked for, op6's classes (covering masks, radius 2) are found as well
and their links join the others before components are taken, so no link of either kind
is lost; a text far from another by its set may be within two bits of it, since
fingerprints count repeats.

Defined results: null, empty and wordless texts have the empty set and are
copies of each other; repeated rows are copies; a null doc_id takes part and is
kept only where its component has no other; of rows of one doc_id and text one
stays; all columns are kept, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, join_spread, materialise
from .simhash import _signed, classes, connected, fingerprint

SHINGLE = 5
#: Texts are near copies from this Jaccard similarity on, as a fraction of whole numbers.
LEAST = (4, 5)
ROWS, BANDS = 6, 40
#: Bits of a minimum that the quick test looks at, and how many minima of a pair may differ in them.
PLANES = 4
DIFFER = 82
#: Longs that hold a bit of each minimum.
LONGS = -(-ROWS * BANDS // 64)
#: Bits that hold the parities of a set, a multiple of 64. With 1024, Spark's code for the quick test has over 8,000 bytes, which the JVM does not compile.
PARITIES = 512
SEED = 42
#: Buckets of so many nodes are compared pair by pair at once.
SMALL = 8
#: Centres of the second round, which is left out where no more than PAIRS pairs for each node of a bucket are left.
CENTRES = 4
PAIRS = 100
#: Nodes of a bucket that one task holds against all of it, and pairs of a task, about.
PART = 1024
TASK_PAIRS = 100_000

_random = random.Random(7)
_XOR = np.array([_random.getrandbits(32) for _ in range(ROWS * BANDS)], np.uint32)
_TIMES = np.array([_random.getrandbits(32) | 1 for _ in range(ROWS * BANDS)], np.uint32)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The different shingles of text, as sorted 32-bit hashes."""
    # On bytes, lower() and split() know exactly A-Z and the six ASCII white-space characters.
    words = (text or "").encode(errors="replace").lower().split()
    if not words:
        return np.array([], np.uint32)
    joined = b" ".join(words)
    if len(words) < size:
        return np.array([xxhash.xxh32_intdigest(joined, SEED)], np.uint32)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh32_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1 :])], np.uint32))


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(ROWS * BANDS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(hashes), 256):
        least = np.minimum(least, ((hashes[i : i + 256, None] ^ _XOR) * _TIMES).min(axis=0))
    return least


def bands(least: np.ndarray) -> list[int]:
    """A key for each band of a set's minima."""
    return [_signed(xxhash.xxh64_intdigest(part.tobytes(), i)) for i, part in enumerate(least.reshape(BANDS, ROWS))]


def sketch(least: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """PLANES bits of each minimum, in planes of LONGS longs, and the parities. The bits are low ones, since the minima of great sets are small."""
    bits = np.zeros((PLANES, LONGS * 64), np.uint8)
    for i in range(PLANES):
        bits[i, : len(least)] = least >> np.uint32(8 + i) & np.uint32(1)
    odd = np.bincount(hashes % np.uint32(PARITIES), minlength=PARITIES) & 1
    return np.packbits(np.concatenate([bits.ravel(), odd.astype(np.uint8)])).view(np.int64)


def sketched(texts: DataFrame, fingerprints: bool = False) -> DataFrame:
    """(node, size, keys, sketch, shingles, fp) of the texts (node, text), once for each text of a part of the table; fp is null unless asked for."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                if node in seen:
                    continue
                seen.add(node)
                found = shingles(text)
                least = minima(found)
                fp = _signed(fingerprint(text)) if fingerprints else None
                rows.append((node, len(found), bands(least) if len(found) else [0], sketch(least, found), found.view(np.int32), fp))
            for i in range(0, len(rows), 1000):
                cols = list(zip(*rows[i : i + 1000]))
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["node", "size", "keys", "sketch", "shingles", "fp"])

    return texts.select("node", "text").mapInArrow(run, "node long, size int, keys array<long>, sketch array<long>, shingles array<int>, fp long")


def fingerprinted(sketches: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, from the least node of each of op6's classes to its others, as a table."""
    hashed = materialise(sketches.select(F.col("node").alias("doc_id"), "fp").distinct(), "near-fingerprints")
    components = classes(hashed)
    named = join_spread(hashed, components, ["fp"], "n").filter(F.col("component_id") < F.col("doc_id"))
    found = materialise(named.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")), "near-classes")
    forget(hashed, components)
    return found


def _sized(a: str, b: str) -> Column:
    """Whether sets of the sizes a and b can be similar enough."""
    return F.least(a, b) * LEAST[1] >= F.greatest(a, b) * LEAST[0]


def _likely(x: str, y: str, x_size: str, y_size: str) -> Column:
    """Whether the sketches x and y of sets of these sizes differ in few minima, and in no more parities than near copies can differ in shingles."""
    differ = [F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i))) for i in range(PLANES * LONGS + PARITIES // 64)]
    minima, odd = differ[: PLANES * LONGS], differ[PLANES * LONGS :]
    few = sum(F.bit_count(functools.reduce(Column.bitwiseOR, minima[i::LONGS])) for i in range(LONGS)) <= DIFFER
    # Sets of n shingles in all that differ in d have the similarity (n - d) / (n + d).
    return (sum(map(F.bit_count, odd)) * sum(LEAST) <= (F.col(x_size) + F.col(y_size)) * (LEAST[1] - LEAST[0])) & few


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the different pairs (a, b) that pass the quick test. sketches: one row for each node."""
    x, y = (sketches.select(F.col("node").alias(n), F.col("sketch").alias(s), F.col("size").alias(f"{s}_size")) for n, s in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").filter(_likely("x", "y", "x_size", "y_size")).select("a", "b")


def similar(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the different pairs (a, b) whose sets are near copies, as a table."""
    pairs = materialise(pairs, "near-likely")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = materialise(sketches.select("node", "shingles").join(nodes, "node", "left_semi"), "near-shingles")
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common, either = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    found = materialise(met.filter(common * LEAST[1] >= (either - common) * LEAST[0]).select("a", "b"), "near-links")
    forget(pairs, sets)
    return found


def centred(rows: DataFrame, seeds: range) -> DataFrame:
    """Pairs (a, b) of each bucket's rows (key, node, size, root) with a centre for each seed, where their components differ."""
    # The same orders in all buckets, so that a group's buckets mostly agree on the centres.
    centre = [F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("by"), F.col("node").alias("c"), F.col("root").alias("c_root"), F.col("size").alias("c_size"))) for i in seeds]
    centres = rows.groupBy("key").agg(F.array(*centre).alias("m")).select("key", F.inline("m")).drop("by")
    met = rows.join(centres, "key").filter((F.col("root") != F.col("c_root")) & _sized("size", "c_size"))
    return met.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def crossed(rows: DataFrame, parts: Column, tasks: int | None = None, *more: str) -> DataFrame:
    """Pairs of a bucket's rows (key, node, size, root, *more) in different components, as columns p_... and q_...

    One side of a bucket is dealt into so many parts, so that a large bucket is
    not one task's. Few rows make many pairs, so their bytes don't tell how many
    tasks are right.
    """
    names = ["node", "size", "root", *more]
    split = rows.withColumn("parts", parts.cast("int"))
    p = split.select("key", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), *(F.col(c).alias(f"p_{c}") for c in names))
    q = split.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"q_{c}") for c in names))
    if tasks:
        p, q = p.repartition(tasks, "key", "part"), q.repartition(tasks, "key", "part")
    return p.join(q, ["key", "part"]).filter((F.col("p_root") != F.col("q_root")) & (F.col("p_node") < F.col("q_node")) & _sized("p_size", "q_size"))


def links(shared: DataFrame, sketches: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of the components of near copies among the nodes of buckets (key, node, size, n), n being no less than the bucket's nodes, and of known links (a, b)."""
    every = shared.select("node")
    if known is not None:
        every = every.union(known.select("a")).union(known.select("b"))
    nodes = materialise(every.distinct().withColumn("root", F.col("node")), "near-nodes")
    every = nodes.select("node")
    pair = [F.col("p_node").alias("a"), F.col("q_node").alias("b")]
    own = shared.withColumn("root", F.col("node"))
    few, many = own.filter(F.col("n") <= SMALL), own.filter(F.col("n") > SMALL).drop("root")
    found = crossed(few, F.lit(1)).select(*pair).union(centred(own.filter(F.col("n") > SMALL), range(1)))
    edges = similar(likely(found.distinct(), sketches), sketches)
    if known is not None:
        old, edges = edges, materialise(edges.union(known), "near-edges")
        forget(old)
    old = [nodes]
    for last in (False, True):
        roots = connected(edges)
        nodes = materialise(every.join(roots.withColumnRenamed("root", "r"), "node", "left").select("node", F.coalesce("r", "node").alias("root")), "near-nodes")
        forget(roots)
        placed = materialise(many.join(nodes, "node"), "near-placed")
        # Pairs of a bucket in different components: half of n * n less the squares of its components' sizes.
        inside = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
        left = inside.groupBy("key").agg(F.sum("n").alias("all"), ((F.sum("n") ** 2 - F.sum(F.col("n") ** 2)) / 2).alias("pairs"), F.count("*").alias("roots")).filter("roots > 1")
        left = materialise(left, "near-left")
        rows, pairs = left.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
        if not rows:
            forget(placed, left)
            break
        mixed = placed.join(left.select("key", "all"), "key")
        last = last or pairs <= PAIRS * rows
        if last:
            # The quick test is part of the join, so that only likely pairs are shuffled.
            quick = materialise(mixed.join(sketches.select("node", "sketch"), "node"), "near-mixed")
            met = crossed(quick, F.ceil(F.col("all") / PART), min(20_000, int(pairs) // TASK_PAIRS + 1), "sketch").filter(_likely("p_sketch", "q_sketch", "p_size", "q_size")).select(*pair).distinct()
        else:
            met = likely(centred(mixed.select("key", "node", "size", "root"), range(1, 1 + CENTRES)), sketches)
        new = similar(met, sketches)
        both = materialise(edges.union(new), "near-edges")
        forget(placed, left, edges, new, *([quick] if last else []))
        edges = both
        if last:
            roots = connected(edges)
            old.append(nodes)
            nodes = materialise(every.join(roots.withColumnRenamed("root", "r"), "node", "left").select("node", F.coalesce("r", "node").alias("root")), "near-nodes")
            forget(roots)
            break
        old.append(nodes)
    forget(*old, edges)
    return nodes


def keep_one(documents: DataFrame, fingerprints: bool = False) -> DataFrame:
    """documents with one row of each component of near copies (and, if fingerprints, of op6's links): that of the smallest doc_id, and one of its repeats."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = [F.xxhash64(text).alias("node"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")]
    sketches = materialise(sketched(documents.select(keys[0], "text"), fingerprints), "near-sketches")
    known = fingerprinted(sketches) if fingerprints else None
    buckets = sketches.select("node", "size", F.explode("keys").alias("key"))
    # Whether a bucket has two nodes shows from its least and its greatest; nothing is gathered.
    full = materialise(buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).filter("lo != hi").select("key", "n"), "near-buckets")
    shared = materialise(buckets.join(full, "key").groupBy("key", "node").agg(F.max("size").alias("size"), F.max("n").alias("n")), "near-shared")
    # A text that lies in several parts of the table has a row for each; from here on, only texts that share a bucket count, once.
    met = sketches.select("node", "size", "sketch", "shingles").join(shared.select("node").distinct(), "node", "left_semi")
    once = materialise(met.groupBy("node").agg(F.max("size").alias("size"), F.max("sketch").alias("sketch"), F.max("shingles").alias("shingles")), "near-once")
    forget(sketches, full)
    roots = links(shared, once, known)
    forget(once, shared, *([known] if fingerprints else []))
    # Each text's least id, then each component's; a text that a third of the rows have is counted before it meets its root.
    first = documents.select(*keys).groupBy("node").agg(F.min(F.struct("none", "id")).alias("m"))
    named = first.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct("m.none", "m.id", "node").alias("m"))
    kept = materialise(named.groupBy("root").agg(F.min("m").alias("m")).select("m.*"), "near-kept")
    forget(roots)
    whole = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("whole"), *keys)
    left = whole.join(kept, ["node", "none", "id"], "left_semi")
    # The join has put the repeats of a row side by side.
    return left.groupBy("node", "none", "id").agg(F.first("whole").alias("whole")).select("whole.*")
