import re

from quillframe import document_queries, queries

CUT = re.compile(r"\b(\w*key|event_id|n|k|doc_id) < \d+", re.IGNORECASE)


def test_no_query_is_cut_by_an_id():
    for name, (program, sql) in (queries.CATALOG | queries.DOCUMENTS).items():
        assert not CUT.search(program) and not CUT.search(sql), name
    for name, case in document_queries.CASES.items():
        assert not CUT.search(case.program) and not CUT.search(case.sql), name
    assert queries.QUERIES.keys() == queries.ORACLE_SQL.keys()
