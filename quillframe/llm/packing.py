"""Best-fit packing of token sequences, planned by a configuration LP over the length histogram.

Texts are tokenised where they are read. Only the histogram of piece lengths
(at most one count for each length up to the capacity) reaches the driver,
which plans how many sequences of each configuration to fill. A piece's rank
among those of its length then says which sequence it goes to: ranks come from
counts of each partition and length, so no task ever holds all pieces of a
length, and no row is gathered.

Defined results: a null text is an empty one, and an empty text is one piece
that holds only the end token; repeated rows are packed one by one; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .packing_plan import Configuration, plan

CAPACITY = 1024
END = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a byte-level BPE, as its tokenizers file gives them; made on first use in each process.

    The same vocabulary as plain ranks encodes four times as fast and gives the
    same ids; texts that hold a special token's string, which the two treat
    differently, go to the tokenizers library.
    """

    def __init__(self, tokenizer: str, ranks: str | None = None):
        self.tokenizer, self.ranks = tokenizer, ranks
        self._slow = self._fast = None

    def __getstate__(self):
        return {"tokenizer": self.tokenizer, "ranks": self.ranks, "_slow": None, "_fast": None}

    def __call__(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.tokenizer)
            self._special = [t.content for t in self._slow.get_added_tokens_decoder().values()]
        if self.ranks is not None and self._fast is None:
            import public_tokenizers
            import tiktoken

            with open(self.ranks, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self._fast is None or any(s in text for s in self._special):
            return self._slow.encode(text, add_special_tokens=False).ids
        try:
            return self._fast.encode_ordinary(text)
        except BaseException as e:  # the fast library's panics are no Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self._slow.encode(text, add_special_tokens=False).ids


def default_encoder() -> Encoder:
    return Encoder(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but perhaps the first."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(documents: DataFrame, encoder: Encoder, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece, with the part that made it and its number among that part's pieces of its length."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.asarray([*encoder(text or ""), end], "<u4")
                for i, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    rows.append((doc_id, i, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(7)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"])

    schema = "doc_id long, piece long, start long, length long, ids_crc32 long, part long, number long"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


class Places:
    """Where the piece of a given length and rank goes, for a plan."""

    def __init__(self, chosen: list[tuple[Configuration, int]]):
        entries, sequence = [], 0
        ranks: Counter = Counter()
        for config, many in chosen:
            offset = 0
            for s, n in config:
                entries.append((s, ranks[s], n, sequence, offset))
                ranks[s] += n * many
                offset += s * n
            sequence += many
        entries.sort()
        self.sequences = sequence
        self.size, self.first, self.often, self.sequence, self.offset = np.array(entries, np.int64).reshape(-1, 5).T

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(length), np.int64)
        for s in np.unique(length):
            lo, hi = np.searchsorted(self.size, [s, s + 1])
            mine = length == s
            at[mine] = lo + np.searchsorted(self.first[lo:hi], rank[mine], side="right") - 1
        k = rank - self.first[at]
        return self.sequence[at] + k // self.often[at], self.offset[at] + k % self.often[at] * length


def pack(documents: DataFrame, encoder: Encoder | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all documents with the sequence and the offset that each gets."""
    cut = materialise(pieces(documents, encoder or default_encoder(), capacity, end), "packing-pieces")
    counted = materialise(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")
    # A length has a row for each part here, not for each piece.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("n")).collect()}
    places = Places(plan(histogram, capacity))

    def by_length(part: pa.Table) -> pa.Table:
        bases = np.zeros(capacity + 1, np.int64)
        bases[part.column("length").to_numpy()] = part.column("base").to_numpy()
        return pa.table({"part": part.column("part").slice(0, 1), "bases": pa.array([bases], pa.list_(pa.int64()))})

    # A part is what one task has read, and has one row of as many bases as there can be lengths: this list grows with the parts, so it is never sent to all tasks.
    bases = materialise(base.groupBy("part").applyInArrow(by_length, "part long, bases array<long>"), "packing-bases").hint("merge")

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = places(length, rank)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:5]), pa.array(sequence), pa.array(offset)], names=names)

    ranked = cut.join(bases, "part").select("doc_id", "piece", "start", "length", "ids_crc32", (F.get("bases", F.col("length").cast("int")) + F.col("number")).alias("rank"))
    placed = ranked.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("piece", F.col("piece").cast("int"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
