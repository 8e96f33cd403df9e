import random
import re
from collections import Counter

from quillframe.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, documents, odd_texts):
    r = random.Random(4)
    texts = odd_texts + ["".join(r.choice(["a", "b", "cc", " ", "  ", "\n", "#", "\t", "é|", "\r\n"]) for _ in range(r.randint(0, 200))) for _ in range(150)]
    rows = {x.doc_id: x for x in quality.verdicts(documents(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        n, *rest = brute(t)
        got = rows[i]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (n, *rest), (i, t)
        assert got.base_failed == (n < 50 or 100 * rest[3] > 50 * n)
        assert not (got.base_failed and got.kept)


def test_junk_goes_and_prose_stays(spark, documents):
    r = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "ll", "sh", "de", "ric")]

    def prose():
        return "\n".join(" ".join(r.choice(["the", "of", "and", "to"]) if k % 4 == 0 else r.choice(vocabulary) for k in range(30)).capitalize() + "." for _ in range(4))

    good = [prose() for _ in range(80)]
    shouting = [prose().upper().replace(" ", "!! ") for _ in range(8)]
    symbols = [" ".join(w + "%%%" for w in prose().split()) for _ in range(8)]
    tables = ["\n".join(" | ".join(r.choice(vocabulary) for _ in range(12)) + " |" for _ in range(10)) for _ in range(8)]
    rows = {x.doc_id: x.kept for x in quality.verdicts(documents(good + shouting + symbols + tables)).collect()}
    assert all(rows[i] for i in range(80)) and not any(rows[i] for i in range(80, 104))


def test_main_path_is_native(spark, documents):
    plan = quality.measures(documents(["a b c"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_estimate_learns_which_rule_to_trust():
    # Rule a follows the hidden class, rule b says good to everything.
    patterns = [((1, 1, 1), 700), ((-1, 1, -1), 250), ((1, 1, -1), 30), ((-1, 1, 1), 20)]
    prior, weights = quality.estimate(patterns, ["a", "b", "c"])
    assert weights["a"][1] > 1 and weights["a"][-1] < -1 and abs(weights["b"][1]) < 0.5
    assert quality.estimate([], ["a"])[0] == 0.0


def test_empty_table(spark, documents):
    assert quality.verdicts(documents(["x"]).limit(0)).count() == 0
