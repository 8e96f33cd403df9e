"""SentencePiece encoding and decoding by suffix-array matching.

The different words of a batch are written one after another and indexed by a
suffix array; every piece of the vocabulary finds all its occurrences by binary
search. The occurrences are the edges of a lattice over the text. Sorted by
position they are relaxed: in each round every word takes its best edge that
joins two neighbouring symbols, until none is left. That is the merging order
of a BPE model, whose segmentation is not a shortest path over piece scores.

Words are independent because no piece goes on into a next word (this is
checked when a model is loaded). Very long words are relaxed with a queue, so
that work stays in proportion to their length.

Defined results: a null text is an empty one, with no ids; characters outside
the vocabulary become byte pieces (or the unknown piece where a model has
none); repeated rows are encoded each; an empty table gives no rows; only
doc_id and text are read.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: Characters (counted in bytes) of new words that are indexed at once.
INDEX_CHARS = 300_000
#: Words that are remembered from one slice to the next, and bytes of them and their ids.
REMEMBERED = 1_000_000
REMEMBERED_BYTES = 64_000_000
#: Rows and bytes of text that are encoded at once.
SLICE_ROWS = 4_000
SLICE_BYTES = 8_000_000
#: Words of more characters are relaxed one by one.
LONG_WORD = 48


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _sorted_by(keys: list[np.ndarray]) -> np.ndarray:
    """Places in order of the keys, the first counts most. Later keys are looked at only where the ones before are equal."""
    order = np.argsort(keys[0])
    first = keys[0][order]
    same = first[1:] == first[:-1]
    for key in keys[1:]:
        tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        group = np.cumsum(~np.concatenate([[False], same]))[tied]
        places = order[tied]
        order[tied] = places[np.lexsort([key[places], group])]
        same &= key[order[1:]] == key[order[:-1]]
    return order


class PieceModel:
    """The vocabulary of a SentencePiece BPE model, and the matcher over it. Loaded on first use in each process."""

    def __init__(self, path: str):
        self.path, self.loaded = path, False

    def __reduce__(self):
        return _of_process, (self.path,)

    def load(self) -> PieceModel:
        if self.loaded:
            return self
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=self.path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.names[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.hidden = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(not re.fullmatch(f"{SPACE}*[^{SPACE}]*", self.names[i]) for i in plain):
            raise ValueError("a piece of this model goes on into a next word")
        chars = sorted({c for i in plain for c in self.names[i]})
        # 0 ends a word, 1 is every character that no piece has.
        self.rank = {c: k + 2 for k, c in enumerate(chars)}
        self.ranks = np.ones(0x110000, np.uint16)
        self.ranks[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
        self.width = -(-max(len(self.names[i]) for i in plain) // 8) * 8
        score = np.array([sp.get_score(i) for i in range(n)])
        self.priority = np.empty(n, np.int64)  # lower is merged first
        self.priority[np.argsort(-score, kind="stable")] = np.arange(n)
        codes = np.zeros((len(plain), self.width), np.uint16)
        for row, i in enumerate(plain):
            codes[row, : len(self.names[i])] = [self.rank[c] for c in self.names[i]]
        self.piece_ids, self.piece_len = np.array(plain), np.array([len(self.names[i]) for i in plain])
        self.piece_codes = codes
        # What each id adds to a decoded text; None where bytes have to be put together first.
        self.texts: list[str | None] = [x.replace(SPACE, " ") for x in self.names]
        for k, b in self.byte_of.items():
            self.texts[k] = chr(b) if b < 128 else None
        for k in self.hidden:
            self.texts[k] = ""
        self.texts[self.unknown] = " ⁇ "
        self.raw = pa.array([bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(self.texts)], pa.large_binary())
        self.ids_of_bytes = np.array([self.byte_id.get(b, self.unknown) for b in range(256)], np.int32)
        # The ids of each word (int32, one after another), words as UTF-8.
        self.memory: dict[bytes, bytes] = {}
        self.held = 0  # bytes of both
        self.loaded = True
        return self

    # -- matching

    def edges(self, text: np.ndarray) -> np.ndarray:
        """For each place of text and each length, the piece there (-1: none)."""
        n, w = len(text), self.width
        # Few different characters take a byte each, so that eight fit a sort key; else they take two.
        present = np.flatnonzero(np.bincount(text, minlength=2))
        narrow = len(present) < 250
        kind, per = (np.uint8, 8) if narrow else (np.uint16, 4)
        codes, ids, lengths = self.piece_codes, self.piece_ids, self.piece_len
        if narrow:
            dense = np.full(len(self.rank) + 2, 255, np.uint8)
            dense[present] = np.arange(len(present)) + (0 if present[0] == 0 else 1)
            dense[0] = 0
            text, codes = dense[text], dense[codes]
            here = (codes != 255).all(axis=1)
            codes, ids, lengths = codes[here], ids[here], lengths[here]
        padded = np.concatenate([text, np.zeros(w, text.dtype)])
        bits = 64 // per
        keys = [sum(padded[per * k + j : per * k + j + n].astype(np.uint64) << np.uint64(64 - bits * (j + 1)) for j in range(per)) for k in range(w // per)]
        # The suffix array, to the depth of the longest piece: no piece tells deeper suffixes apart.
        suffixes = _sorted_by(keys)
        size = w * np.dtype(kind).itemsize
        ordered = np.stack([k[suffixes] for k in keys], axis=1).astype(">u8").view(f"S{size}").ravel()
        big = np.dtype(kind).newbyteorder(">")
        top = codes.copy()
        top[np.arange(w)[None, :] >= lengths[:, None]] = np.iinfo(kind).max
        low, high = (np.ascontiguousarray(c.astype(big)).view(f"S{size}").ravel() for c in (codes, top))
        low, high = np.searchsorted(ordered, low, side="left"), np.searchsorted(ordered, high, side="right")
        count = np.maximum(0, high - low)
        which = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        place = suffixes[low[which] + within]
        # A table by place and length has the edges sorted by place at once.
        out = np.full((n + 1, w + 1), -1, np.int32)
        out[place, lengths[which]] = ids[which]
        return out

    def relax(self, edges: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbol that starts at a place ends, and the places where one starts, when no edge joins neighbours any more."""
        n, w = len(edges) - 1, self.width
        after, begins = np.arange(1, n + 2), np.ones(n + 1, bool)
        long_ = end - start > LONG_WORD
        for a, b in zip(start[long_].tolist(), end[long_].tolist()):
            self._relax_one(edges, after, begins, a, b)
        start, end = start[~long_], end[~long_]
        # Symbols of all other words, with the word of each.
        size = end - start
        word = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        stop = end[word]
        none = np.iinfo(np.int64).max
        while len(place):
            second = after[place]
            third = after[np.minimum(second, n)]
            length = third - place
            possible = (second < stop) & (length <= w)
            piece = edges[place, np.where(possible, length, 0)]
            cost = np.where(possible & (piece >= 0), self.priority[piece], none)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(cost, first)
            counts = np.diff(np.concatenate([first, [len(word)]]))
            goes_on = np.repeat(best < none, counts)
            hit = (cost == np.repeat(best, counts)) & goes_on
            at = np.flatnonzero(hit)
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])] if len(at) else at  # leftmost of a word
            gone = second[at]
            after[place[at]] = after[gone]
            begins[gone] = False
            keep = goes_on.copy()
            keep[at + 1] = False  # a symbol that was joined to its left neighbour is none any more
            place, word, stop = place[keep], word[keep], stop[keep]
        return after, begins

    def _relax_one(self, edges: np.ndarray, after: np.ndarray, begins: np.ndarray, a: int, b: int) -> None:
        w = self.width
        nxt = {p: p + 1 for p in range(a, b)}
        prev = {p: p - 1 for p in range(a, b)}
        queue: list[tuple[int, int, int, int]] = []

        def offer(p: int) -> None:
            q = nxt[p]
            if p >= a and q < b and nxt[q] - p <= w and (piece := edges[p, nxt[q] - p]) >= 0:
                heapq.heappush(queue, (int(self.priority[piece]), p, q, nxt[q]))

        for p in range(a, b - 1):
            offer(p)
        while queue:
            _, p, q, r = heapq.heappop(queue)
            if nxt.get(p) != q or nxt.get(q) != r:
                continue
            nxt[p] = r
            del nxt[q]
            if r < b:
                prev[r] = p
                offer(p)
            if p > a:
                offer(prev[p])
        begins[a:b] = False
        for p, e in nxt.items():
            after[p], begins[p] = e, True

    def learn(self, words: list[bytes]) -> None:
        """Encode words that are not remembered yet."""
        # Each word is followed by the end mark, which no piece holds.
        joined = b"\n".join([*words, b""])
        text = self.ranks[np.frombuffer(joined.decode().encode("utf-32-le"), "<u4")]
        # Where each character starts, and the characters at which words do.
        byte = np.flatnonzero((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        end = np.searchsorted(byte, ends - 1)
        start = np.concatenate([[0], end[:-1] + 1])
        text[end] = 0
        edges = self.edges(text)
        after, first = self.relax(edges, start, end)
        first[end] = False
        at = np.flatnonzero(first[: len(text)])
        ids = edges[at, after[at] - at]
        # Characters without a piece become their bytes.
        size = np.ones(len(at), np.int64)
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            if self.byte_id:
                size[odd] = byte[at[odd] + 1] - byte[at[odd]]
            ids = np.repeat(ids, size)
            own = np.frombuffer(joined, np.uint8)[_ragged(byte[at[odd]], size[odd])]
            ids[ids < 0] = self.ids_of_bytes[own] if self.byte_id else self.unknown
        bounds = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(at, np.concatenate([start, [len(text)]]))]
        flat, bounds = ids.tobytes(), (bounds * ids.itemsize).tolist()
        for word, low, high in zip(words, bounds, bounds[1:]):
            self.memory[word] = flat[low:high]
        self.held += len(joined) + len(flat)

    def encode_flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8) one after another, and where each text's begin and the last one's end."""
        self.load()
        parts = [self.sp.normalize(t) if t else b"" for t in texts]
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        joined = np.frombuffer(b"".join(parts), np.uint8)
        # A word starts at a text's start and at each mark that follows no other mark.
        starts = np.zeros(len(joined) + 1, bool)
        mark = np.flatnonzero(joined[:-2] == SPACE_BYTES[0]) if len(joined) > 2 else np.empty(0, np.int64)
        mark = mark[(joined[mark + 1] == SPACE_BYTES[1]) & (joined[mark + 2] == SPACE_BYTES[2])]
        starts[mark[np.diff(mark, prepend=-len(SPACE_BYTES) - 1) != len(SPACE_BYTES)]] = True
        starts[bounds] = True
        offsets = np.flatnonzero(starts)
        n = len(offsets) - 1
        found = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        words = found.dictionary.to_pylist()
        new: list[bytes] = []
        size = 0
        for word in words:
            if word not in self.memory:
                new.append(word)
                size += len(word)
                if size >= INDEX_CHARS:
                    self.learn(new)
                    new, size = [], 0
        if new:
            self.learn(new)
        own = [self.memory[w] for w in words]
        if len(self.memory) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.memory.clear()
            self.held = 0
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        which = found.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        ids = np.frombuffer(b"".join(own), np.int32)[_ragged((np.cumsum(sizes) - sizes)[which], sizes[which])]
        return ends[np.searchsorted(offsets, bounds)], ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        bounds, ids = self.encode_flat([(t or "").encode() for t in texts])
        flat, bounds = ids.tolist(), bounds.tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8, marks as spaces, without the space put before the text."""
        self.load()
        try:
            text = "".join(map(self.texts.__getitem__, ids))
        except TypeError:
            text = self._decode_bytes(ids)
        return text[1:] if text.startswith(" ") else text

    def gives_back(self, texts: list[bytes], bounds: np.ndarray, ids: np.ndarray) -> list[bool]:
        """Whether decode() of each text's ids, as encode_flat() gives them, is that text."""
        self.load()
        _, offsets, data = pc.take(self.raw, pa.array(ids)).buffers()
        data = data.to_pybytes() if data else b""
        places = (np.frombuffer(offsets, np.int64)[bounds] if len(ids) else bounds).tolist()
        out = []
        for k, text in enumerate(texts):
            got = data[places[k] : places[k + 1]]
            # Other bytes may still be the same text, where decode() replaces what is no UTF-8.
            out.append((got[1:] if got.startswith(b" ") else got) == text or self.decode(ids[bounds[k] : bounds[k + 1]].tolist()).encode() == text)
        return out

    def _decode_bytes(self, ids: list[int]) -> str:
        parts: list[str] = []
        pending = bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                parts.append(pending.decode(errors="replace"))
                pending.clear()
            parts.append(self.texts[i])
        return "".join([*parts, pending.decode(errors="replace")])


@functools.cache
def _of_process(path: str) -> PieceModel:
    """The model that all tasks of a process share, with the words that it remembers."""
    return PieceModel(path)


def _slices(batches):
    """doc_id and text (UTF-8, a null text empty) of batches cut small, so that a task holds the ids of few texts at once."""
    for batch in batches:
        doc_id, text = batch.column("doc_id"), batch.column("text").cast(pa.binary())
        at = size = 0
        for end, more in enumerate(pc.fill_null(pc.binary_length(text), 0).to_pylist(), 1):
            size += more
            if size >= SLICE_BYTES or end - at == SLICE_ROWS or end == len(text):
                yield doc_id.slice(at, end - at), [t or b"" for t in text.slice(at, end - at).to_pylist()]
                at, size = end, 0


def _lists(bounds: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def encode(documents: DataFrame, model: PieceModel) -> DataFrame:
    """(doc_id, ids) for each row."""

    def run(batches):
        for doc_id, texts in _slices(batches):
            yield pa.RecordBatch.from_arrays([doc_id, _lists(*model.encode_flat(texts))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """(doc_id, text) for rows of (doc_id, ids)."""

    def run(batches):
        for batch in batches:
            texts = [model.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_checked(documents: DataFrame, model: PieceModel) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip): ids of each text, and whether decoding gives the text back."""

    def run(batches):
        for doc_id, texts in _slices(batches):
            bounds, ids = model.encode_flat(texts)
            same = pa.array(model.gives_back(texts, bounds, ids), pa.bool_())
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(bounds), pa.int64()), _lists(bounds, ids), same], names=["doc_id", "n_ids", "ids", "round_trip"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def default_model() -> PieceModel:
    import public_tokenizers

    return PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_checked(table(spark, sf_dir, "documents"), default_model())
