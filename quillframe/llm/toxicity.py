"""Toxicity scores: boosted trees over dense text features, with isotonic calibration.

The features are lexicon densities, hits near second-person words, capitals,
punctuation and obfuscation rates. The lexicon is a short seed list and what
the labelled sample adds to it: words, and beginnings of words, that toxic
texts hold far more often than others. Labels are read only to fit; a score
depends on the text alone. Calibration is isotonic at every size: two models
score the half of the rows that each has not seen, and the map is fitted on
those margins.

Defined results: a null or empty text is scored like any other (all features
are 0); rows repeat as they come; a table without usable labels gives a
constant score below one half; of the labels of one document, and of equal
texts, the toxic one holds; columns beside doc_id and text are ignored by
score() and kept by filter_toxic().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Isotonic
from .common import forget, held_out, materialise, sampled, table

#: Labelled rows that a model is fitted on, at most about (rows are taken by a hash of doc_id).
MAX_TRAIN_ROWS = 20_000
#: Entries of the learned lexicon, at most.
MAX_LEXICON = 3_000
THRESHOLD = 0.5

SEEDS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown ugly"
    " fool jerk bastard bitch whore slut crap shit fuck fucking asshole hate kill die vermin filth retard imbecile"
    " dummkopf arschloch scheisse abschaum connard salaud merde ordure imbécile idiota estúpido mierda basura cabrón".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch tu toi ton tes vous votre vos tú ti tus usted ustedes".split()
)
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
EDGE = "\"'`.,;:!?()[]{}<>*#%&$|-_~"
PREFIXES = range(3, 8)
STRETCHED = re.compile(r"([^\W\d_])\1\1")
SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_]\s){3,}[^\W\d_](?!\S)")
NAMES = (
    "log_words", "word_length", "seed_density", "seed_count", "learned_density", "learned_count", "learned_weight",
    "strongest", "near_second_person", "second_person", "capitals", "upper_words", "exclamations", "punctuation",
    "symbols", "obfuscated", "obfuscated_hits", "stretched", "digits",
)


def grams(word: str) -> list[str]:
    """The word itself and its beginnings, as lexicon keys."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


class Words(dict):
    """word -> row of its properties, worked out once for each distinct word."""

    LIMIT = 200_000

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.rows = lexicon, np.zeros((4096, 6))

    def __missing__(self, word: str) -> int:
        core = word.strip(EDGE)
        obfuscated = not core.isalpha() and any(not c.isalpha() and c not in "'-." for c in core) and any(c.isalpha() for c in core)
        plain = "".join(c for c in core.translate(LEET) if c.isalpha()) if obfuscated else core
        weight = max((self.lexicon.get(g, 0.0) for g in grams(plain)), default=0.0) if plain else 0.0
        seed = plain in SEEDS
        stretched = STRETCHED.search(core) is not None
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = seed, weight, core in SECOND_PERSON, obfuscated, obfuscated and (seed or weight > 0), stretched
        self[word] = at
        return at


@dataclass
class Featuriser:
    """Text to a vector of NAMES."""

    lexicon: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._words = Words(self.lexicon)

    def __getstate__(self):
        return {"lexicon": self.lexicon}

    def __setstate__(self, state):
        self.lexicon = state["lexicon"]
        self._words = Words(self.lexicon)

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        words = text.split()
        n = len(words)
        if not n:
            return [0.0] * len(NAMES)
        if len(self._words) > Words.LIMIT:
            self._words = Words(self.lexicon)
        low = text.lower().split()
        joined = ["".join(x.split()) for x in SPELLED.findall(text.lower())]
        at = np.fromiter(map(self._words.__getitem__, low), np.int64, len(low))
        props = self._words.rows[at]
        seed, weight, second, odd, odd_hit, stretched = props.T
        hit = (seed > 0) | (weight > 0)
        spelled = sum(1 for w in joined if w in SEEDS or "=" + w in self.lexicon)
        near = 0.0
        if hit.any() and second.any():
            around = np.convolve(second, np.ones(11))[5 : 5 + n] > 0
            near = float((hit & around).sum())
        byte = np.bincount(np.frombuffer(text.encode(errors="replace"), np.uint8), minlength=256)
        chars = len(text)
        letters = max(1, int(byte[65:91].sum() + byte[97:123].sum()))
        learned = weight > 0
        return [
            math.log1p(n), chars / n, float(seed.sum()) / n, math.log1p(seed.sum()), float(learned.sum()) / n, math.log1p(learned.sum()),
            math.log1p(weight.sum()), float(weight.max()), near / n, float(second.sum()) / n, float(byte[65:91].sum()) / letters,
            sum(map(str.isupper, words)) / n, float(byte[33]) / chars, float(byte[[34, 39, 44, 46, 58, 59, 63]].sum()) / chars,
            float(byte[[35, 42, 36, 37, 38, 124, 60, 62]].sum()) / chars, float(odd.sum()) / n, float(odd_hit.sum()) + spelled,
            float(stretched.sum()) / n, float(byte[48:58].sum()) / chars,
        ]


@dataclass
class ToxicityModel:
    featuriser: Featuriser
    trees: BoostedTrees
    calibration: Isotonic

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.asarray([self.featuriser(t) for t in texts], float).reshape(len(texts), len(NAMES))
        return np.clip(self.calibration(self.trees.margin(x)), 0.0, 1.0)


def training_rows(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of labelled rows that may be learned from; of many, about max_rows, dealt by a hash of doc_id."""
    usable = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.filter(sampled(F.xxhash64("doc_id"), usable.count(), max_rows))
    # At most about max_rows small rows go to all tasks, and texts stay where they are.
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id")
    return rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "text", "toxic")


def fit(rows: DataFrame, max_lexicon: int = MAX_LEXICON) -> ToxicityModel:
    """Learn the lexicon, the trees and the calibration from (doc_id, text, toxic)."""
    rows = materialise(rows, "toxicity-rows")
    totals = dict(rows.groupBy("toxic").count().collect())
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    lexicon = _lexicon(rows, toxic, clean, max_lexicon) if toxic and clean else {}
    featuriser = Featuriser(lexicon)

    def vectors(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "toxic": batch.column("toxic").cast(pa.int32()),
                "x": pa.array([featuriser(t) for t in texts], pa.list_(pa.float64())),
            })

    got = rows.mapInArrow(vectors, "doc_id long, toxic int, x array<double>").select("toxic", "x", F.xxhash64("doc_id", F.lit(7)).alias("h"))
    table = got.toArrow().sort_by("h")
    forget(rows)
    y = np.asarray(table.column("toxic").to_pylist(), float)
    x = np.asarray(table.column("x").to_pylist(), float).reshape(len(y), len(NAMES))
    trees = BoostedTrees().fit(x, y)
    if len(np.unique(y)) < 2:
        return ToxicityModel(featuriser, trees, _constant(y))
    # Each class is halved by itself, so that both halves know both classes wherever there are two rows of each.
    half = np.zeros(len(y), bool)
    for label in (0, 1):
        half[np.flatnonzero(y == label)[::2]] = True
    margin = np.zeros(len(y))
    for part in (half, ~half):
        margin[~part] = BoostedTrees().fit(x[part], y[part]).margin(x[~part])
    return ToxicityModel(featuriser, trees, Isotonic().fit(margin, y))


def _constant(y: np.ndarray) -> Isotonic:
    out = Isotonic()
    out.x, out.y = np.array([0.0]), np.array([float(y[0]) * 0.98 + 0.01 if len(y) else 0.01])
    return out


def _lexicon(rows: DataFrame, toxic: int, clean: int, most: int) -> dict[str, float]:
    def count(batches):
        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found: set[str] = set()
                for word in {w.strip(EDGE) for w in text.lower().split()}:
                    if word and word.isalpha():
                        found.update(grams(word))
                counts[label].update(found)
        names = list(counts[1])  # a gram that no toxic text of this part holds adds only to the clean count
        names += [g for g in counts[0] if g not in counts[1]]
        for i in range(0, len(names), 100_000):
            part = names[i : i + 100_000]
            yield pa.RecordBatch.from_pydict({
                "gram": pa.array(part, pa.string()), "toxic": pa.array([counts[1][g] for g in part], pa.int64()),
                "clean": pa.array([counts[0][g] for g in part], pa.int64()),
            })

    counted = rows.select("text", "toxic").mapInArrow(count, "gram string, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    kept = counted.filter(F.col("toxic") >= max(4, round(toxic * 0.004))).withColumn("weight", weight).filter("weight > 2.3")
    return {r.gram: r.weight for r in kept.orderBy(F.desc("weight"), "gram").limit(most).collect()}


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """Documents' doc_id with held_out, score and predicted, for each row."""

    def run(batches):
        for batch in batches:
            s = model.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(s, pa.float64())})

    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_toxic(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of documents, with all their columns, whose score is under threshold."""
    schema = documents.schema

    def run(batches):
        for batch in batches:
            keep = model.score(batch.column("text").to_pylist()) < threshold
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(documents, fit(training_rows(documents, labels)))
