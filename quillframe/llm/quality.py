"""Quality verdicts by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule looks at one property of a text and votes good (1), bad (-1) or
abstains (0). How often each vote comes from good and from bad texts is
estimated without labels, from the counts of vote patterns over all documents
(at most 3**8 patterns, whatever the number of documents), and a text
is kept where the posterior probability of being good reaches one half and the
fixed base test passes. Everything that touches rows is DataFrame expressions.

Defined results: a null text is an empty one (no words, base test failed, not
kept); repeated rows get a verdict each; an empty table gives no rows; only
doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, materialise, table

STOP_WORDS = (
    "the of and to in is that it for on with as was be by this are from at or an not a"
    " der die und das den von zu mit ist im für auf dem nicht ein eine"
    " le la les de et des un une du que qui dans pour pas sur est par au avec"
    " el los las y en del se por con no su para es lo una"
).split()


def measures(documents: DataFrame) -> DataFrame:
    """One row for each document, with the counts that the base test and the rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.array_remove(F.split(text, WHITE + "+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    n = F.size("words")
    hashed = split.select(
        "*",
        F.when(n >= 3, F.transform(F.slice("words", 1, n - 2), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    return hashed.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike("[.!?\"»…:;]\\s*$"))).alias("n_ended"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).alias("n_stop"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).alias("n_capitals"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).alias("n_exclaims"),
    )


def _repeat_words() -> Column:
    """Words inside three-word windows that come twice or more.

    Windows are sorted by their whole 64-bit hash and place, so that equal ones
    are neighbours; most texts repeat none and skip the sort.
    """
    n = F.size("windows")
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = F.zip_with(
        F.slice(ordered, 1, n - 1),
        F.slice(ordered, 2, n - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    starts = F.array_distinct(F.flatten(same))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2))))
    return F.when(n < 2, 0).when(F.size(F.array_distinct("windows")) == n, 0).otherwise(F.size(covered)).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(value: Column, bad, good) -> Column:
    return F.when(bad(value), -1).when(good(value), 1).otherwise(0).cast("int")


def _share(part: str, of: str = "n_words") -> Column:
    return F.col(part) / F.greatest(F.col(of), F.lit(1))




def rules() -> dict[str, Column]:
    return {
        "symbols": _vote(_share("n_symbols"), lambda x: x > 0.15, lambda x: x < 0.03),
        "capitals": _vote(_share("n_capitals", "word_chars"), lambda x: x > 0.3, lambda x: x < 0.12),
        "exclaims": _vote(_share("n_exclaims"), lambda x: x > 0.1, lambda x: x < 0.02),
        "repeats": _vote(_share("n_repeat_words"), lambda x: x > 0.25, lambda x: x < 0.1),
        # Of few lines, one that comes twice (a heading, a signature) says nothing yet.
        "lines": _vote(F.when(F.col("n_dup_lines").isin(1, 2), 0.1).otherwise(_share("n_dup_lines", "n_lines")), lambda x: x > 0.3, lambda x: x == 0),
        "stop_words": _vote(_share("n_stop"), lambda x: x < 0.05, lambda x: x > 0.12),
        "endings": _vote(_share("n_ended", "n_lines"), lambda x: x < 0.25, lambda x: x > 0.6),
        "word_length": _vote(_share("word_chars"), lambda x: (x < 2.5) | (x > 12), lambda x: (x > 3) & (x < 9)),
    }


#: What a rule is believed to do before any text is seen: rates of its votes over bad (0) and good (1) texts, worth this share of all texts.
BELIEF = {0: {-1: 0.35, 0: 0.15, 1: 0.5}, 1: {-1: 0.02, 0: 0.08, 1: 0.9}}
BELIEF_SHARE = 0.05


def estimate(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 60) -> tuple[float, dict[str, dict[int, float]]]:
    """Prior log-odds of good and, for each rule and vote, the log-odds that the vote adds.

    patterns: votes in the order of names, with the number of texts that have them.
    Posteriors and vote rates are estimated in turn, from a start by the counts
    of votes. Rates are drawn towards BELIEF, and a vote never counts against its
    own direction, so that the two classes can't swap names and a rule that only
    a rare kind of junk sets off keeps its say.
    """
    prior, weights = 0.0, {r: {v: 0.7 * v for v in (-1, 0, 1)} for r in names}
    total = sum(c for _, c in patterns)
    if not total:
        return prior, weights
    # A rule seldom calls a good text bad, so at first one such vote outweighs several good ones.
    post = [_sigmoid(0.5 + 0.5 * votes.count(1) - 2.0 * votes.count(-1)) for votes, _ in patterns]
    strength = BELIEF_SHARE * total + 2
    for _ in range(rounds):
        good = sum(p * c for p, (_, c) in zip(post, patterns))
        share = min(max((good + 1) / (total + 2), 0.02), 0.98)
        prior = math.log(share / (1 - share))
        for k, rule in enumerate(names):
            for v in (-1, 0, 1):
                g = sum(p * c for p, (votes, c) in zip(post, patterns) if votes[k] == v)
                b = sum((1 - p) * c for p, (votes, c) in zip(post, patterns) if votes[k] == v)
                g = (g + strength * BELIEF[1][v]) / (good + strength)
                b = (b + strength * BELIEF[0][v]) / (total - good + strength)
                weights[rule][v] = 0.0 if v == 0 else v * min(max(v * math.log(g / b), 0.0), 4.0)
        post = [_sigmoid(prior + sum(weights[r][v] for r, v in zip(names, votes))) for votes, _ in patterns]
    return prior, weights


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))


def verdicts(documents: DataFrame) -> DataFrame:
    """The base counts of each document with base_failed, the posterior probability of being good, and kept."""
    votes = rules()
    names = list(votes)
    measured = materialise(measures(documents).select("*", base_failed().alias("base_failed"), *(v.alias(f"vote_{k}") for k, v in votes.items())), "quality")
    counted = measured.filter(~F.col("base_failed")).groupBy(*(f"vote_{k}" for k in names)).count()
    prior, weights = estimate([(tuple(r[:-1]), r[-1]) for r in counted.orderBy(*counted.columns).collect()], names)
    logit = F.lit(prior)
    for k in names:
        logit = logit + F.when(F.col(f"vote_{k}") == 1, weights[k][1]).when(F.col(f"vote_{k}") == -1, weights[k][-1]).otherwise(0.0)
    posterior = 1 / (1 + F.exp(-logit))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (posterior >= 0.5)).alias("kept"), posterior.alias("posterior"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))
