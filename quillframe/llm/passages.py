"""Passages of over 50 words that stand in two different texts, found exactly at the size of the shared part.

Words are compared, not the white space between them. Of every SPAN-word window
the GRAM-word piece with the least hash is its anchor, so equal windows have
equal anchors. An anchor with up to SIDE words on both sides is a segment. A
segment that two texts share settles both. Only texts that share an anchor, but
no segment, ask further: the windows around those anchors are hashed, one
representative of each other segment beside them, and a window that comes from
two texts is a shared passage.

No group of texts is ever gathered: everything is counted by hash with the
least and the greatest text that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CHARS, forget, materialise

#: Words of the shortest passage, of an anchor, and of the context on each side of an anchor.
SPAN = 51
GRAM = 21
SIDE = SPAN - GRAM
#: The fewest bytes that SPAN words take.
LEAST_BYTES = 2 * SPAN - 1
#: Bytes of texts looked at together, and words of a part of one longer text.
TOGETHER = 1 << 20
PART = 1 << 19
#: Rows of one text are dealt to this many tasks when windows are fetched.
SALTS = 16
PLACE = np.uint64((1 << 20) - 1)

_random = np.random.default_rng(51)
_SYMBOLS = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), np.frombuffer(WHITE_CHARS.encode(), np.uint8))
_BASE, _WORD_BASE = (int(x) * 2 + 1 for x in _random.integers(1, 1 << 62, 2))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts that begin at starts in data, and the number of its text."""
    filled = ~_SPACE[data]
    at = np.flatnonzero(filled)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begins = np.ones(len(data), bool)
    begins[1:] = ~filled[:-1]
    begins[starts[starts < len(data)]] = True
    first = begins[at]
    word = np.cumsum(first) - 1
    place = at - at[first][word]
    powers = _powers(_BASE, int(place.max()) + 1)
    found = np.add.reduceat(_SYMBOLS[data[at]] * powers[place], np.flatnonzero(first))
    return _mix(found), np.searchsorted(starts, at[first], side="right") - 1


class _Ranges:
    """Hashes of any range of words."""

    def __init__(self, words: np.ndarray):
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _powers(_WORD_BASE, len(words))[: len(words)], out=self.sums[1:])
        self.inverse = _powers(pow(_WORD_BASE, -1, 1 << 64), len(words))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def anchors(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place in all words, anchor, segment) of the anchors of all windows; words of one text lie together."""
    n = len(words)
    if n < SPAN:
        return (np.zeros(0, np.int64),) * 4
    windows = np.flatnonzero(text[: n - SPAN + 1] == text[SPAN - 1 :])
    hashes = _Ranges(words)
    starts = np.arange(n - GRAM + 1)
    h = hashes(starts, starts + GRAM)
    # Ties go to the rightmost, so the choice depends on the words alone.
    key = (h & ~PLACE) | (PLACE - starts.astype(np.uint64))
    place = np.unique(PLACE - (_sliding_min(key, SIDE + 1)[windows] & PLACE)).astype(np.int64)
    first = np.searchsorted(text, text[place], side="left")
    last = np.searchsorted(text, text[place], side="right")
    left, right = np.minimum(SIDE, place - first), np.minimum(SIDE, last - place - GRAM)
    segment = _mix(hashes(place - left, place + GRAM + right) ^ (left * 64 + right).astype(np.uint64))
    return text[place], place, h[place], segment


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of width values, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def window_hashes(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The different windows around the anchors at places, of the words of one text."""
    start = (places[:, None] - np.arange(SIDE + 1)[None, :]).ravel()
    start = np.unique(start[(start >= 0) & (start + SPAN <= len(words))])
    return np.unique(_Ranges(words)(start, start + SPAN))


def _together(data: list, most: int = TOGETHER) -> Iterator[list[int]]:
    """Numbers of texts, as many as have most bytes or a single longer one."""
    held, size = [], 0
    for i, d in enumerate(data):
        if held and size + len(d) > most:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(d)
    if held:
        yield held


def _rows(batch: pa.RecordBatch, seen: set) -> Iterator[pa.RecordBatch]:
    keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
    data = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("data")]
    new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
    for held in _together([data[i] for i in new]):
        chosen = [new[i] for i in held]
        sizes = np.array([len(data[i]) for i in chosen], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        words, text = word_hashes(np.concatenate([data[i] for i in chosen]), starts)
        own = np.searchsorted(text, np.arange(len(chosen)))  # the first word of each text
        for at in range(0, max(1, len(words)), PART):
            # Parts of a very long text overlap by all but one word of a window.
            stop = min(len(words), at + PART + SPAN - 1)
            t, place, anchor, segment = anchors(words[at:stop], text[at:stop])
            if len(t):
                k = np.array([keys[i] for i in chosen], np.int64).reshape(-1, 2)[t]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array((place + at - own[t]).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64))],
                    names=["k1", "k2", "place", "anchor", "segment"],
                )


def shared_passages(docs: DataFrame, copied: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(k1, k2) of texts of docs (k1, k2, data, row) that share a passage with another text, and the written tables it reads.

    copied: (k1, k2) of texts that come twice or more; they need not ask.
    """

    def find(batches):
        seen: set = set()
        for batch in batches:
            yield from _rows(batch, seen)

    long_enough = docs.filter(F.octet_length("data") >= LEAST_BYTES)
    every = materialise(long_enough.select("k1", "k2", "data").mapInArrow(find, "k1 long, k2 long, place int, anchor long, segment long"), "passages-anchors")
    lo_hi = [F.min("k1").alias("lo"), F.max("k1").alias("hi")]
    # Written first, the counts are read by a shuffle of their own, and adaptive execution can split a hot anchor.
    twice = materialise(every.groupBy("anchor").agg(*lo_hi).filter("lo != hi").select("anchor"), "passages-twice")
    both = materialise(every.join(twice, "anchor", "left_semi"), "passages-shared")
    forget(every, twice)
    segments = both.groupBy("anchor", "segment").agg(*lo_hi, F.min(F.struct("k1", "k2", "place")).alias("one"))
    segments = materialise(segments, "passages-segments")
    known = both.join(segments.filter("lo != hi").select("anchor", "segment"), ["anchor", "segment"], "left_semi").select("k1", "k2").distinct()
    known = materialise(known, "passages-known")

    asking = both.select("k1", "k2").distinct().join(known, ["k1", "k2"], "left_anti").join(copied, ["k1", "k2"], "left_anti")
    asking = materialise(asking, "passages-asking")
    asked = materialise(both.join(asking, ["k1", "k2"], "left_semi").select("anchor").distinct(), "passages-asked")
    places = segments.join(asked, "anchor", "left_semi").groupBy(F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2")).agg(F.collect_list("one.place").alias("places"))
    # The rows of a text that comes often are dealt to several tasks, which hash the same windows.
    places = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def windows(batches):
        seen: set = set()
        for batch in batches:
            for k1, k2, data, found in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("data"), batch.column("places").to_pylist()):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                words, _ = word_hashes(np.frombuffer(data.as_buffer(), np.uint8), np.zeros(1, np.int64))
                h = window_hashes(words, np.array(found, np.int64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k1)), pa.array(np.full(len(h), k2)), pa.array(h)], names=["k1", "k2", "h"])

    salted = long_enough.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    hashed = salted.join(places, ["k1", "k2", "salt"]).select("k1", "k2", "data", "places").mapInArrow(windows, "k1 long, k2 long, h long")
    hashed = materialise(hashed, "passages-windows")
    met = hashed.groupBy("h").agg(*lo_hi).filter("lo != hi").select("h")
    later = hashed.join(asking, ["k1", "k2"], "left_semi").join(met, "h", "left_semi").select("k1", "k2").distinct()
    later = materialise(later, "passages-later")
    forget(both, segments, asking, asked, hashed)
    return known.union(later), [known, later]
