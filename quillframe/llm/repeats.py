"""Exact removal of long repeated byte strings, within and across documents.

A byte goes if some LENGTH-byte string over it starts anywhere else too.

Finding candidates. Of every LENGTH-byte string the GRAM-byte piece with the
least hash is its anchor; equal strings have equal anchors at equal places, so
every repeat shows as a repeated anchor, and only one position in about
CONTEXT/2 is an anchor. An anchor with its CONTEXT bytes on both sides is a
segment. A segment that comes twice is repeated throughout. Segments that
differ are compared where they share an anchor and half the context on one
side; their bytes, and no others, leave the documents.

Comparing. The segments of a chunk are built up column by column from the
right, one symbol of every segment in each round: the segments' order (the
column of the collection's Burrows-Wheeler transform) and the common prefixes
of neighbours follow from those of the round before. All segments of a group
are aligned on their anchor, so a string can only repeat in the same column,
and older columns are never needed again; a round is one sequential pass over
a symbol, an order and a prefix array, which stay in memory because a chunk is
bounded. Two neighbours whose common prefix spans CONTEXT and the anchor have
a repeated string there. Groups too large for a chunk are settled by counts of
whole strings instead, which needs no group in one place.

Documents are known by two hashes of their text, so exact copies are one
content with a count.

Passages of over 50 words that also stand in another document (passages.py) are
often shorter than LENGTH bytes. They are not removed, but shared_passage marks
the documents that hold one.

Defined results: a null text is an empty one (nothing removed, the hash of no
bytes, no passage); repeated rows are copies like any other, so texts of LENGTH bytes or
more that repeat go whole; an empty table gives no rows; only doc_id and text
are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialise, table
from .passages import LEAST_BYTES, SPAN, shared_passages

LENGTH = 400
GRAM = 160
#: Context on each side that, with the anchor, makes up a string; half of it splits groups.
CONTEXT = LENGTH - GRAM
HALF = CONTEXT // 2
#: Different segments of a group that are compared in one place, at most, and segments of a chunk.
LARGE_GROUP = 2_000
CHUNK = 16_000
#: String starts hashed at once, whatever a document's length.
STRIDE = 1 << 18
PLACE = np.uint64((1 << 20) - 1)

_random = np.random.default_rng(400)
SYMBOLS = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = int(_random.integers(1, 1 << 62)) * 2 + 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STRIDE + 4 * LENGTH)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (BASE, BASE_INVERSE)]
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Polynomial hashes modulo 2**64 of any byte range of data."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(SYMBOLS[data] * self.power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of all LENGTH-byte strings of data: place, hash, segment hash and the hashes with half the context (0: none)."""
    n, out = len(data), []
    for first in range(0, n - LENGTH + 1, STRIDE):
        last = min(first + STRIDE, n - LENGTH + 1)  # starts of strings
        base, stop = max(0, first - CONTEXT), min(n, last - 1 + LENGTH + CONTEXT)
        hashes = Hashes(data[base:stop])
        grams = np.arange(first - base, last + CONTEXT - base)
        h = hashes(grams, grams + GRAM)
        # Ties go to the rightmost, so the choice depends on the string alone.
        key = (h & ~PLACE) | (PLACE - np.arange(len(h), dtype=np.uint64))
        at = PLACE - (sliding_min(key, CONTEXT + 1) & PLACE)
        at = np.unique(at).astype(np.int64)
        place = at + first
        left, right = np.minimum(CONTEXT, place), np.minimum(CONTEXT, n - place - GRAM)
        rel = place - base
        segment = _mix(hashes(rel - left, rel + GRAM + right) ^ (left * 1024 + right).astype(np.uint64))
        near = np.where(left >= HALF, hashes(np.maximum(0, rel - HALF), rel + GRAM), np.uint64(0))
        far = np.where(right >= HALF, hashes(rel, np.minimum(len(data) - base, rel + GRAM + HALF).clip(max=stop - base)), np.uint64(0))
        out.append((place, h[at], segment, near, far, left, right))
    if not out:
        return {}
    names = ("place", "anchor", "segment", "near", "far", "left", "right")
    joined = dict(zip(names, (np.concatenate(c) for c in zip(*out))))
    _, once = np.unique(joined["place"], return_index=True)
    return {k: v[once] for k, v in joined.items()}


def repeated_columns(columns: np.ndarray, low: int, high: int, span: int) -> np.ndarray:
    """For rows of columns (symbols), whether columns c..c+span-1 equal another row's, for c from low to high.

    Rounds go from the last column needed to low. order is the rows sorted by
    what is inserted so far, prefix the common prefix of each with the one
    before, capped at span.
    """
    m = len(columns)
    found = np.zeros((m, high - low + 1), bool)
    order, prefix = np.arange(m), np.zeros(m, np.uint8)
    for c in range(high + span - 1, low - 1, -1):
        symbol = columns[order, c]
        place = np.argsort(symbol, kind="stable")
        symbol = symbol[place]
        # The common prefix of new neighbours is one more than the least prefix between their old places.
        levels = [prefix]
        while 2 ** len(levels) <= m:
            half = 2 ** (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        least = np.zeros(m, np.uint8)
        a, b = place[:-1] + 1, place[1:] + 1
        same = np.flatnonzero(symbol[1:] == symbol[:-1])
        a, b = a[same], b[same]  # with one symbol, old places rise
        level = np.frexp((b - a).astype(float))[1] - 1
        for k in np.unique(level):
            mine = level == k
            least[same[mine] + 1] = np.minimum(levels[k][a[mine]], levels[k][b[mine] - 2**k])
        prefix = np.zeros(m, np.uint8)
        prefix[same + 1] = np.minimum(least[same + 1], span - 1) + 1
        order = order[place]
        if c <= high:
            full = prefix >= span
            full[:-1] |= full[1:]
            found[order, c - low] = full
    return found


def matrix_of(lefts: list[bytes], rights: list[bytes], groups: np.ndarray) -> np.ndarray:
    """Rows of left context, one symbol for the group, right context; what is missing differs from every byte."""
    out = np.full((len(lefts), 2 * CONTEXT + 1), 256, np.uint32)
    for i, (a, b) in enumerate(zip(lefts, rights)):
        out[i, CONTEXT - len(a) : CONTEXT] = np.frombuffer(a, np.uint8)
        out[i, CONTEXT + 1 : CONTEXT + 1 + len(b)] = np.frombuffer(b, np.uint8)
    out[:, CONTEXT] = groups
    return out


def starts_of(lefts: list[bytes], rights: list[bytes], groups: np.ndarray, side: int) -> list[list[tuple[int, int]]]:
    """For each segment, ranges of bytes before its anchor at which repeated strings start.

    side 0: strings with HALF bytes or more before the anchor; side 1: the others.
    """
    low, high = (0, CONTEXT - HALF) if side == 0 else (CONTEXT - HALF + 1, CONTEXT)
    columns = matrix_of(lefts, rights, groups)
    # Byte columns sort by counting; only the group's column needs more than 16 bits.
    found = repeated_columns(columns.astype(np.uint16) if len(columns) < 1 << 16 else columns, low, high, CONTEXT + 1)
    la, ra = np.array([len(a) for a in lefts]), np.array([len(b) for b in rights])
    c = np.arange(low, high + 1)
    found &= (CONTEXT - c[None, :] <= la[:, None]) & (c[None, :] <= ra[:, None])
    out = []
    for row in found:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        out.append([(CONTEXT - (low + int(s)), CONTEXT - (low + int(e) - 1)) for s, e in zip(edge[::2], edge[1::2])])
    return out


KEYS = ["k1", "k2"]


def keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(29), text).alias("k2"), text.cast("binary").alias("data"),
        F.xxhash64(F.lit(31), "doc_id").alias("row"),
    )


def removed_spans(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(k1, k2, spots, copies, passage) for contents that lose bytes or share a passage, and the written tables that it still reads.

    spots are (a, b), bytes a to b exclusive, in any order, perhaps overlapping;
    copies: the content comes twice or more; passage: another content shares one.
    """

    def find(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            parts = []
            for k1, k2, data in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("data")):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                found = anchors(np.frombuffer(data.as_buffer(), np.uint8))
                if found:
                    parts.append((np.full(len(found["place"]), k1), np.full(len(found["place"]), k2), *found.values()))
            if parts:
                c = [np.concatenate(x) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2].astype(np.int64)), *(pa.array(x.view(np.int64)) for x in c[3:7]), pa.array(c[7].astype(np.int16)), pa.array(c[8].astype(np.int16))],
                    names=["k1", "k2", "place", "anchor", "segment", "near", "far", "left", "right"],
                )

    long_enough = docs.filter(F.octet_length("data") >= LENGTH)
    worded = docs.filter(F.octet_length("data") >= min(LENGTH, LEAST_BYTES))
    whole = worded.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max(F.octet_length("data")).cast("long").alias("b")).filter("n > 1")
    whole = materialise(whole, "repeats-copies")
    every = long_enough.select("k1", "k2", "data").mapInArrow(find, "k1 long, k2 long, place long, anchor long, segment long, near long, far long, left short, right short")
    every = materialise(every, "repeats-anchors")
    twice = materialise(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "repeats-twice")
    shared = materialise(every.join(twice, "anchor", "left_semi"), "repeats-shared")
    forget(every, twice)

    # One row for each different segment; of a segment that comes twice or more, all is repeated.
    one = F.min(F.struct("k1", "k2", "place")).alias("one")
    kinds = materialise(shared.groupBy("anchor", "segment", "near", "far").agg(F.count("*").alias("n"), one), "repeats-kinds")
    often = kinds.filter("n > 1").select("anchor", "segment")
    again = shared.join(often, ["anchor", "segment"]).select("k1", "k2", (F.col("place") - F.col("left")).alias("a"), (F.col("place") + GRAM + F.col("right")).alias("b"))

    # Groups: different segments that share the anchor and half the context on one side.
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("near").alias("key")), F.struct(F.lit(1).alias("side"), F.col("far").alias("key")))).alias("s")
    members = kinds.select("anchor", "segment", "n", "one", sides).select("anchor", "segment", "n", "one", "s.*").filter("key != 0")
    groups = members.groupBy("side", "key").agg(F.count("*").alias("size"), F.max((F.col("n") == 1).cast("int")).alias("asks")).filter("size > 1 AND asks = 1")
    wanted = members.join(groups.select("side", "key", "size"), ["side", "key"])
    spot = F.struct("side", "key", F.col("one.place").alias("place"), (F.col("n") == 1).alias("asks"), (F.col("size") > LARGE_GROUP).alias("large")).alias("spot")
    places = wanted.select(F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2"), spot).groupBy(*KEYS).agg(F.collect_list("spot").alias("spots"))
    places = materialise(places, "repeats-places")

    def contexts(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for k1, k2, data, spots in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "data", "spots"))):
                if (k1, k2) in seen:  # copies of a content are one
                    continue
                seen.add((k1, k2))
                for s in spots:
                    p = s["place"]
                    rows.append((k1, k2, p, s["side"], s["key"], s["asks"], s["large"], data[max(0, p - CONTEXT) : p], data[p + GRAM : p + GRAM + CONTEXT]))
            for i in range(0, len(rows), 20_000):
                cols = list(zip(*rows[i : i + 20_000]))
                kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_)], names=["k1", "k2", "place", "side", "key", "asks", "large", "before", "after"])

    fetched = long_enough.select("k1", "k2", "data").join(places, KEYS).mapInArrow(
        contexts, "k1 long, k2 long, place long, side int, key long, asks boolean, large boolean, before binary, after binary"
    )
    # A content that lies in several parts is fetched more than once; one row of each is compared.
    fetched = materialise(fetched.groupBy("k1", "k2", "place", "side", "key").agg(*(F.first(c).alias(c) for c in ("asks", "large", "before", "after"))), "repeats-contexts")
    forget(places)

    def compare(batches):
        held: list[dict] = []

        def settle(rows: list[dict]):
            for side in (0, 1):
                mine = [r for r in rows if r["side"] == side]
                if len(mine) < 2:
                    continue
                _, group = np.unique([r["key"] for r in mine], return_inverse=True)
                for r, ranges in zip(mine, starts_of([r["before"] for r in mine], [r["after"] for r in mine], group, side)):
                    if r["asks"]:
                        for most, least in ranges:
                            yield r["k1"], r["k2"], r["place"] - most, r["place"] - least + LENGTH

        def batch_of(found):
            cols = list(zip(*found)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k1", "k2", "a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                # Rows come sorted by group, so a chunk ends where a group does.
                if len(held) >= CHUNK and (row["side"], row["key"]) != (held[-1]["side"], held[-1]["key"]):
                    yield batch_of(settle(held))
                    held = []
                held.append(row)
        yield batch_of(settle(held))

    small = fetched.filter(~F.col("large")).repartition("side", "key").sortWithinPartitions("side", "key")
    edges = small.mapInArrow(compare, "k1 long, k2 long, a long, b long")

    # Large groups: strings of the side, as hashes of what lies around the anchor; equal ones are counted wherever they are.
    offset = F.explode(F.when(F.col("side") == 0, F.sequence(F.lit(HALF), F.lit(CONTEXT))).otherwise(F.sequence(F.lit(0), F.lit(HALF - 1)))).alias("l")
    large = fetched.filter("large").select("*", offset).filter((F.col("l") <= F.octet_length("before")) & (CONTEXT - F.col("l") <= F.octet_length("after")))
    # substring() takes bytes of a binary column, where left() and right() would read it as text.
    around = F.concat(F.expr("substring(before, octet_length(before) - l + 1, l)"), F.expr(f"substring(after, 1, {CONTEXT} - l)"))
    strings = large.select("k1", "k2", "place", "asks", "side", "key", "l", F.xxhash64(around).alias("h"), F.xxhash64(F.lit(5), around).alias("g"))
    repeated = strings.groupBy("side", "key", "l", "h", "g").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    begun = strings.filter("asks").join(repeated, ["side", "key", "l", "h", "g"]).select("k1", "k2", (F.col("place") - F.col("l")).alias("a"), (F.col("place") - F.col("l") + LENGTH).alias("b"))

    spots = whole.filter(F.col("b") >= LENGTH).select("k1", "k2", F.lit(0).cast("long").alias("a"), "b").unionByName(again).unionByName(edges).unionByName(begun)
    spots = materialise(spots.groupBy(*KEYS).agg(F.collect_set(F.struct("a", "b")).alias("spots")), "repeats-spots")
    forget(shared, kinds, fetched)
    shared_, tables = shared_passages(docs, whole.select("k1", "k2"))
    none = F.lit(None).cast("array<struct<a: bigint, b: bigint>>").alias("spots")
    yes, no = F.lit(True), F.lit(False)
    marks = spots.select("k1", "k2", "spots", no.alias("copies"), no.alias("passage"))
    marks = marks.unionByName(whole.select("k1", "k2", none, yes.alias("copies"), no.alias("passage")))
    marks = marks.unionByName(shared_.select("k1", "k2", none, no.alias("copies"), yes.alias("passage")))
    return marks.groupBy(*KEYS).agg(F.max("spots").alias("spots"), F.max("copies").alias("copies"), F.max("passage").alias("passage")), [whole, spots, *tables]


def union_of(spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spots):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed spans and shared_passage (1 or 0) of each row of documents."""
    docs = keyed(documents)
    listed, inputs = removed_spans(docs)
    listed = materialise(listed, "repeats-spans")
    forget(*inputs)

    def run(batches):
        for batch in batches:
            rows = []
            for data, spots, copies, passage in zip(*(batch.column(c).to_pylist() for c in ("data", "spots", "copies", "passage"))):
                cut = union_of([(s["a"], s["b"]) for s in spots or ()])
                digest, at = hashlib.sha256(), 0
                for a, b in cut:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                marked = passage or copies and len(data.split()) >= SPAN
                rows.append((len(data), sum(b - a for a, b in cut), len(cut), digest.hexdigest(), ",".join(f"{a}:{b}" for a, b in cut), int(bool(marked))))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "shared_passage"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    joined = docs.join(listed, KEYS, "left").select("doc_id", "data", "spots", "copies", "passage")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed string, shared_passage int")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
