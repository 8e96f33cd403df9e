import random

from quillframe.llm import pii


def test_no_pattern_is_left_out(spark, documents):
    r = random.Random(9)
    secret = lambda: f"a1b2c3d4e5f6g{r.randrange(10**6):06d}h{r.randrange(10**6):06d}"
    n = 10_100
    texts = [f"cue{i}= {secret()} . cue{i}= {secret()} . cue{i}= {secret()} . cue{i}= {100 + i % 900}-{10_000 + i}" for i in range(n)]
    docs = documents(texts)
    patterns = pii.induce(docs)
    rows = {x.doc_id: x.spans for x in pii.report(docs, patterns).collect()}
    assert all(rows[i].count("secret:") == 4 for i in range(n))


def test_table_of_patterns_finds_what_the_model_in_memory_finds(spark, documents, odd_texts, monkeypatch):
    r = random.Random(10)
    texts = [*odd_texts, *(f"my badge: {r.getrandbits(96):024x} or {r.randint(100, 999)}-{i} badge: {r.randint(100, 999)}-{1000 + i} mail a{i}@b.cd" for i in range(60))]
    docs = documents(texts)
    small = pii.induce(docs)
    monkeypatch.setattr(pii, "MODEL_BYTES", 0)
    large = pii.induce(docs)
    assert small and {x.pattern: x.kind for x in large.collect()} == small
    want = {x.doc_id: x for x in pii.report(docs, small).collect()}
    assert {x.doc_id: x for x in pii.report(docs, large).collect()} == want
    masked = pii.redact(docs, large)
    assert masked.columns == docs.columns
    assert {x.doc_id: x.text for x in masked.collect()} == {x.doc_id: x.text for x in pii.redact(docs, small).collect()}
