"""Personal data: fixed forms first, then identifiers that bootstrapped context patterns discover.

The fixed forms (e-mail, IP, card and phone numbers) and long random-looking
strings are seeds. What stands before a seed (a cue such as `token = "`, or
the cue with the word before it) is a pattern; Spark scores the graph of patterns and
instances in rounds: a pattern is as good as the instances it precedes, and an
instance as good as the patterns that precede it. Patterns that end well
supported find further identifiers, which need not have a fixed form.

Defined results: a null text is an empty one (no spans); repeated rows each
get a row; an empty table gives no rows and induces no pattern; redact() keeps
all columns of its input and touches text (and n_chars, where there is one).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: Rounds of scoring, and what a pattern needs to be used.
ROUNDS = 3
LEAST_SCORE = 0.7
LEAST_SEEDS = 3
#: A model up to this many bytes goes to every task; a greater one stays a table, joined with the candidates by pattern.
MODEL_BYTES = 2_000_000

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs and look-behinds give the leftmost-longest matches of the plain forms in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: An identifier-like value, and the cue before it.
VALUE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?")
WORD = re.compile(r"\S+")
CUE = re.compile(r"(?:([^\s\"'=:#]{1,30})\s)?([^\s\"'=:#]{2,40})\s?([=:#])\s?[\"']?\Z")
BEFORE = 90

Span = tuple[int, int, int]  # start, kind, end
Patterns = dict[str, int] | DataFrame


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed forms, by start and then kind; end is exclusive, in code points."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        at = text.find("@")
        while at >= 0:
            start = at
            while start > end and text[start - 1] in LOCAL_CHARS:
                start -= 1
            m = DOMAIN.match(text, at) if start < at else None
            if m:
                end = m.end()
                out.append((start, 0, end))
            at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, spans: list[Span]) -> Iterator[tuple[int, int, int, list[str]]]:
    """(start, end, seed kind or -1, patterns before it) of the fixed forms and of other identifier-like values."""
    for start, kind, end in spans:
        yield start, end, kind, contexts(text, start)
    if not DIGIT.search(text):
        return
    taken = [(s, e) for s, _, e in spans]
    for word in WORD.finditer(text):
        if not DIGIT.search(word[0]):
            continue
        for m in VALUE.finditer(word[0]):
            start, end = word.start() + m.start(), word.start() + m.end()
            digits = len(DIGIT.findall(m[0]))
            if end - start < 6 or digits < 3 or any(s < end and start < e for s, e in taken):
                continue
            letters = sum(c.isalpha() for c in m[0])
            seed = 4 if end - start >= 16 and digits >= 5 and letters >= 3 and m[0].isalnum() else -1
            yield start, end, seed, contexts(text, start)


def contexts(text: str, start: int) -> list[str]:
    """Keys of the patterns that text before start has: its cue, and its cue with the word before that.

    Without the cue's mark a word is no pattern: common words stand before
    identifiers as before anything else.
    """
    m = CUE.search(text[max(0, start - BEFORE) : start])
    if not m:
        return []
    cue = f"{m[2].lower()}{m[3]}"
    return [cue, f"{m[1].lower()} {cue}"] if m[1] else [cue]


def induce(documents: DataFrame) -> Patterns:
    """Patterns worth using, with the kind that they introduce: a table (pattern, kind) beyond MODEL_BYTES."""

    def edges(batches):
        for batch in batches:
            rows: dict[tuple[str, str], int] = {}
            for text in batch.column("text").to_pylist():
                text = text or ""
                for start, end, seed, patterns in candidates(text, base_spans(text)):
                    for p in patterns:
                        key = (p, hashlib.blake2b(text[start:end].encode(errors="replace"), digest_size=12).hexdigest())
                        rows[key] = max(seed, rows.get(key, -1))
            yield pa.RecordBatch.from_pydict({
                "pattern": pa.array([k[0] for k in rows], pa.string()), "instance": pa.array([k[1] for k in rows], pa.string()),
                "seed": pa.array(list(rows.values()), pa.int32()),
            })

    found = documents.select("text").mapInArrow(edges, "pattern string, instance string, seed int")
    graph = materialise(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-graph")
    scores = graph.groupBy("instance").agg((F.max("seed") >= 0).cast("double").alias("score"))
    for i in range(ROUNDS):
        patterns = graph.join(scores, "instance").groupBy("pattern").agg(*_support())
        if i < ROUNDS - 1:
            rated = graph.join(patterns.select("pattern", F.col("score").alias("rate")), "pattern")
            # A seed stays sure; another instance is as likely as not all of its patterns err.
            scores = materialise(
                rated.groupBy("instance").agg(
                    F.when(F.max("seed") >= 0, 1.0).otherwise(1 - F.exp(F.sum(F.log(1 - 0.95 * F.col("rate"))))).alias("score")
                ),
                "pii-scores",
            )
    # The kind of most seeds, the first of them where several are equal.
    kind = -F.array_max(F.array(*[F.struct(F.col(f"k{k}").alias("n"), F.lit(-k).alias("k")) for k in range(len(KINDS))]))["k"]
    kept = patterns.filter((F.col("score") >= LEAST_SCORE) & (F.col("seeds") >= LEAST_SEEDS)).select("pattern", kind.alias("kind"))
    kept = materialise(kept, "pii-patterns")
    size = kept.agg(F.coalesce(F.sum(F.octet_length("pattern") + 100), F.lit(0))).first()[0]
    return kept if size > MODEL_BYTES else {r.pattern: r.kind for r in kept.collect()}


def _support() -> list:
    kinds = [F.sum((F.col("seed") == k).cast("long")).alias(f"k{k}") for k in range(len(KINDS))]
    return [(F.sum("score") / (F.count("*") + 0.5)).alias("score"), F.sum((F.col("seed") >= 0).cast("long")).alias("seeds"), *kinds]


def all_spans(text: str, patterns: dict[str, int]) -> tuple[list[Span], list[Span]]:
    """The fixed-form spans, and those with what the patterns find; neither list is in the other's way."""
    base = base_spans(text)
    if not patterns:
        return base, base
    more = []
    for start, end, kind, keys in candidates(text, base):
        if kind in (-1, 4):
            hits = [patterns[k] for k in keys if k in patterns]
            if hits:
                more.append((start, hits[0], end))
    return base, sorted([*base, *more])


def _located(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """documents with __more: the spans (start, kind, end) that a table of patterns finds in each row."""

    def found(batches):
        for batch in batches:
            rows = []
            for row, text in zip(batch.column("__row").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                rows += [(row, start, end, i, k) for start, end, kind, keys in candidates(text, base_spans(text)) if kind in (-1, 4) for i, k in enumerate(keys)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["__row", "start", "end", "place", "pattern"])

    # The numbers are part of the written table, so they stay the same however often it is read.
    numbered = materialise(documents.withColumn("__row", F.monotonically_increasing_id()), "pii-rows")
    keys = numbered.select("__row", "text").mapInArrow(found, "__row long, start long, end long, place long, pattern string")
    hits = keys.join(patterns, "pattern").groupBy("__row", "start", "end").agg(F.min(F.struct("place", "kind"))["kind"].cast("long").alias("kind"))
    more = hits.groupBy("__row").agg(F.collect_list(F.array("start", "kind", "end")).alias("__more"))
    return numbered.join(more, "__row", "left").drop("__row")


def _batch_spans(batch: pa.RecordBatch, patterns: Patterns | None) -> Iterator[tuple[list[Span], list[Span]]]:
    """all_spans() of each text of a batch; without patterns, the column __more has what they find."""
    texts = batch.column("text").to_pylist()
    if patterns is not None:
        yield from (all_spans(t or "", patterns) for t in texts)
        return
    for t, more in zip(texts, batch.column("__more").to_pylist()):
        base = base_spans(t or "")
        yield base, sorted([*base, *map(tuple, more or [])])


def describe(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def report(documents: DataFrame, patterns: Patterns) -> DataFrame:
    """Counts, digest and spans for each document; n_spans counts all spans, those of the patterns included."""
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if isinstance(patterns, DataFrame):
        read, patterns = _located(read, patterns), None

    def run(batches):
        for batch in batches:
            base, every = [], []
            for b, e in _batch_spans(batch, patterns):
                base.append(b)
                every.append(e)
            cols = {"doc_id": batch.column("doc_id")}
            for k, name in enumerate(BASE):
                cols[f"n_{name}"] = pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64())
            cols["base_sha256"] = pa.array([hashlib.sha256(describe(s).encode()).hexdigest() for s in base], pa.string())
            cols["spans"] = pa.array([describe(s) for s in every], pa.string())
            cols["n_spans"] = pa.array([len(s) for s in every], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return read.mapInArrow(run, schema)


def mask(text: str, spans: list[Span]) -> str:
    """text with each span as <KIND>; spans that overlap are one, named by the first."""
    merged: list[list[int]] = []
    for s, k, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    out, at = [], 0
    for s, k, e in merged:
        out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, patterns: Patterns) -> DataFrame:
    """documents with every span of text masked."""
    names, schema = documents.columns, documents.schema
    if isinstance(patterns, DataFrame):
        documents, patterns = _located(documents, patterns), None

    def run(batches):
        for batch in batches:
            texts = [None if t is None else mask(t, e) for t, (_, e) in zip(batch.column("text").to_pylist(), _batch_spans(batch, patterns))]
            cols = dict(zip(names, batch.columns))
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                old = batch.column("n_chars")
                cols["n_chars"] = pa.array([o if t is None else len(t) for o, t in zip(old.to_pylist(), texts)], old.type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return documents.mapInArrow(run, schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return report(documents, induce(documents))
