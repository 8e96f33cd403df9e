from collections import Counter

import pytest

from quillframe.llm import lines


def brute(rows, ratio, least):
    pages, held = Counter(), Counter()
    for source, text in rows:
        pages[source] += 1
        for line in {x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")}:
            held[source, line] += 1
    out = []
    for source, text in rows:
        drop = lambda x: held[source, x] >= least and held[source, x] > ratio * pages[source]
        out.append(None if text is None else "\n".join(x for x in text.split("\n") if not drop(x)))
    return out


@pytest.mark.parametrize("broadcast", [8_000_000, -1])
def test_against_brute_force(spark, documents, odd_texts, broadcast, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", broadcast)
    texts = odd_texts[:7] + [f"Menu\nline {i}\n\nFooter {i % 3}\nMenu" for i in range(60)] + ["Menu", "\n\n", "Menu\nMenu\nx"]
    sources = [None if i % 11 == 0 else "hot" if i % 3 else f"h{i % 2}" for i in range(len(texts))]
    docs = documents(texts, sources=sources)
    out = lines.drop_boilerplate(docs, "source", ratio=0.2, least_pages=3)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r.doc_id: r for r in out.collect()}
    want = brute(list(zip(sources, texts)), 0.2, 3)
    assert [got[i].text for i in range(len(texts))] == want
    assert all(got[i].n_chars == len(t) for i, t in enumerate(want) if t is not None)


def test_against_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
    want = {r[0]: r[1] for r in con.execute(lines.OP8_SQL).fetchall()}
    assert {r.doc_id: r.text for r in lines.op8_line_dedup(spark, data).collect()} == want


def test_small_hosts_and_empty_tables(spark, documents):
    docs = documents(["same line"] * 5)
    assert [r.text for r in lines.drop_boilerplate(docs).collect()] == ["same line"] * 5
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0
