import hashlib
import random
import re

from quillframe.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15])


def test_fixed_forms_are_those_of_the_plain_expressions():
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("0123459.+-@ab ()@.. ") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == brute(t)
    for number in ("4111111111111111", "4111 1111-1111 1111", "4111111111111112"):
        assert pii.base_spans(f"x {number} y") == brute(f"x {number} y")


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1." * 150_000, "+1" * 100_000, "1 " * 150_000):
        pii.all_spans(text, {"x=": 4})


def test_report(spark, documents, odd_texts):
    texts = odd_texts + ["mail é a.b@c.de, 10.0.0.1 or +1 (555) 123-4567", "4111 1111 1111 1111"]
    rows = {r.doc_id: r for r in pii.report(documents(texts), {}).collect()}
    for i, t in enumerate(texts):
        spans = pii.describe(brute(t or ""))
        assert rows[i].spans == spans and rows[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert (rows[len(odd_texts)].n_email, rows[len(odd_texts)].n_ip, rows[len(odd_texts)].n_card, rows[len(odd_texts)].n_phone) == (1, 1, 0, 1)


def test_patterns_find_what_has_no_form(spark, documents):
    r = random.Random(3)
    filler = ["lorem", "ipsum", "dolor", "sit"]
    texts = []
    for i in range(40):
        value = "".join(r.choice("0123456789abcdef") for _ in range(24)) if i % 4 else f"{r.randint(100, 999)}-{r.randint(1000, 9999)}"
        texts.append(" ".join(r.choice(filler) for _ in range(8)) + f" badge: {value} " + r.choice(filler) + f" page {r.randint(1, 9)} of 2024-01-0{r.randint(1, 9)}")
    docs = documents(texts)
    patterns = pii.induce(docs)
    assert "badge:" in patterns and not any("page" in p for p in patterns)
    rows = {x.doc_id: x.spans for x in pii.report(docs, patterns).collect()}
    assert all("secret:" in s for s in rows.values())


def test_redaction_keeps_the_rest(spark, documents, odd_texts):
    docs = documents(odd_texts + ["to a@b.cd, now"])
    out = {r.doc_id: r for r in pii.redact(docs, {}).collect()}
    assert out[len(odd_texts)].text == "to <EMAIL>, now" and out[len(odd_texts)].n_chars == len("to <EMAIL>, now")
    assert all(out[i].text == t for i, t in enumerate(odd_texts)) and pii.redact(docs, {}).columns == docs.columns
    assert pii.mask("abcdef", [(0, 0, 3), (2, 1, 5)]) == "<EMAIL>f"


def test_empty_table(spark, documents):
    empty = documents(["x"]).limit(0)
    assert pii.induce(empty) == {} and pii.report(empty, {}).count() == 0


def test_all_spans_are_counted(spark, documents):
    texts = ["mail a.b@c.de and 10.0.0.1", None, "", "call +44 20 7946 0958 now", "nothing"]
    rows = {r.doc_id: r for r in pii.report(documents(texts), pii.induce(documents(texts))).collect()}
    assert [rows[i].n_spans for i in range(5)] == [2, 0, 0, 1, 0]
    assert all(rows[i].n_spans == len([s for s in rows[i].spans.split(",") if s]) for i in range(5))
