"""Queries over documents made from the benchmark tables, each with the SQL that gives the same rows.

Every row of a table becomes a document (path, content), so that the codec, the
patterns of paths, the mutations and the renderers are held against SQL on all
of its rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .engine import Documents, Tables
from .plans.parser import ParseError, parse_program
from .sources.documents import Options
from .sources.languages import chosen

#: Six ways to carry a header, by doc_id modulo 6: bare, line comments, block comments, and chosen by an interpreter line.
STYLE_PATH = "concat('src/', case doc_id % 6 when 0 then 'a' when 1 then 'b' when 2 then 'c' when 3 then 'd' when 4 then 'run' else 'e' end, doc_id, case doc_id % 6 when 0 then '.md' when 1 then '.py' when 2 then '.js' when 3 then '.sql' when 4 then '' else '.html' end)"
STYLE_CONTENT = r"""case doc_id % 6
  when 0 then concat('---\nk: ', doc_id, '\nlang: ', lang, '\n---\n', text)
  when 1 then concat('#!/usr/bin/env python3\n# ---\n# lang: ', lang, '\n# k: ', doc_id, '\n# ---\nprint(1)\n')
  when 2 then concat('/*---\nk: ', doc_id, '\nlang: ', lang, '\n---*/\nlet x;\n')
  when 3 then concat('select 1;\r\n-- ---\r\n-- k: ', doc_id, '\r\n-- lang: ', lang, '\r\n-- ---\r\n')
  when 4 then concat('#!/bin/bash -e\n# ---\n# k: ', doc_id, '\n# lang: ', lang, '\n# ---\necho\n')
  else concat('<!--\n---\nk: ', doc_id, '\nlang: ', lang, '\n---\n-->\n<p>\n') end"""
SQL_PATH = "'src/' || ['a', 'b', 'c', 'd', 'run', 'e'][doc_id % 6 + 1] || doc_id || ['.md', '.py', '.js', '.sql', '', '.html'][doc_id % 6 + 1]"
#: The same files with the field z set to 1, as SQL; chr(10) and chr(13) end lines.
SQL_UPDATED = """CASE doc_id % 6
  WHEN 0 THEN '---' || chr(10) || 'k: ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || 'z: 1' || chr(10) || '---' || chr(10) || text
  WHEN 1 THEN '#!/usr/bin/env python3' || chr(10) || '# ---' || chr(10) || '# k: ' || doc_id || chr(10) || '# lang: ' || lang || chr(10) || '# z: 1' || chr(10) || '# ---' || chr(10) || 'print(1)' || chr(10)
  WHEN 2 THEN '/*---' || chr(10) || 'k: ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || 'z: 1' || chr(10) || '---*/' || chr(10) || 'let x;' || chr(10)
  WHEN 3 THEN 'select 1;' || chr(13) || chr(10) || '-- ---' || chr(13) || chr(10) || '-- k: ' || doc_id || chr(13) || chr(10) || '-- lang: ' || lang || chr(13) || chr(10) || '-- z: 1' || chr(13) || chr(10) || '-- ---' || chr(13) || chr(10)
  ELSE '<!--' || chr(10) || '---' || chr(10) || 'k: ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || 'z: 1' || chr(10) || '---' || chr(10) || '-->' || chr(10) || '<p>' || chr(10) END"""

#: Files without a header; some must keep their first lines on top, and some are no text.
BARE_PATH = "concat('new/f', doc_id, case doc_id % 5 when 0 then '.md' when 1 then '.py' when 2 then '.css' when 3 then '.rb' else '.go' end)"
BARE_CONTENT = r"""case doc_id % 5
  when 0 then text
  when 1 then concat('#!/usr/bin/python\n# -*- coding: utf-8 -*-\nx = ', doc_id, '\n')
  when 2 then concat('a{top:', doc_id, '}\n')
  when 3 then concat('# frozen_string_literal: true\nputs ', doc_id, '\n')
  else concat('package p', char(0)) end"""
SQL_BARE_PATH = "'new/f' || doc_id || ['.md', '.py', '.css', '.rb', '.go'][doc_id % 5 + 1]"

#: Documents of nations, and hidden ones among them.
NATION_PATH = "concat('n/', if(n_nationkey % 4 = 3, '.', ''), lpad(n_nationkey, 2, '0'), '.md')"
NATION_CONTENT = r"concat('---\nname: ', n_name, '\nregion: ', n_regionkey, '\nkey: ', n_nationkey, '\n---\n')"
SQL_NATION_PATH = "'n/' || CASE WHEN n_nationkey % 4 = 3 THEN '.' ELSE '' END || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.md'"


@dataclass(frozen=True)
class Case:
    """A program over the documents of a table, what of its results is meant, and the SQL of that."""

    table: str
    path: str
    content: str
    program: str
    sql: str
    show: str = "query"  # query, rendered, failed, shown, or the name of a renderer
    options: Options = field(default_factory=Options)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        content = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").selectExpr(f"{self.path} AS path", f"{self.content} AS content")
        documents = Documents(spark, self.options, content)
        if self.show == "query":
            return documents.query(self.program, ordered=False)
        if self.show in ("rendered", "failed", "shown"):
            return getattr(documents, self.show)(self.program)
        return spark.createDataFrame([(documents.run(self.program).text(self.show),)], "output string")


def _boxed(columns: list[str], rows: str) -> str:
    """SQL of the plain rendering of the text columns of rows (a sorted subquery with a column o), with its count."""
    widths = ", ".join(f"CAST(max(greatest(length({c}), {len(c)})) + 2 AS INT) AS w{i}" for i, c in enumerate(columns[:-1]))
    head = " || ".join([f"rpad('{c}', w{i}, ' ')" for i, c in enumerate(columns[:-1])] + [f"'{columns[-1]}'"])
    rule = " || ".join([f"rpad('{'-' * len(c)}', w{i}, ' ')" for i, c in enumerate(columns[:-1])] + [f"'{'-' * len(columns[-1])}'"])
    line = " || ".join([f"rpad({c}, w{i}, ' ')" for i, c in enumerate(columns[:-1])] + [columns[-1]])
    return f"WITH r AS ({rows}), w AS (SELECT {widths} FROM r) SELECT any_value({head}) || chr(10) || any_value({rule}) || chr(10) || string_agg({line} || chr(10), '' ORDER BY o) || '(' || count(*) || ' rows)' || chr(10) AS output FROM r, w"


def _lined(columns: list[str], rows: str) -> str:
    """SQL of the rendering with box characters."""
    n = range(len(columns))
    widths = ", ".join(f"CAST(max(greatest(length({c}), {len(c)})) AS INT) AS w{i}" for i, c in enumerate(columns))

    def rule(left: str, middle: str, right: str) -> str:
        return f"'{left}' || " + f" || '{middle}' || ".join(f"repeat('─', CAST(w{i} + 2 AS INT))" for i in n) + f" || '{right}' || chr(10)"

    def line(cells: list[str]) -> str:
        return "'│' || " + " || ".join(f"' ' || rpad({c}, w{i}, ' ') || ' │'" for i, c in enumerate(cells)) + " || chr(10)"

    head = line([f"'{c}'" for c in columns])
    return (
        f"WITH r AS ({rows}), w AS (SELECT {widths} FROM r) SELECT any_value({rule('┌', '┬', '┐')}) || any_value({head}) || any_value({rule('├', '┼', '┤')})"
        f" || string_agg({line(columns)}, '' ORDER BY o) || any_value({rule('└', '┴', '┘')}) || '(' || count(*) || ' rows)' || chr(10) AS output FROM r, w"
    )


_SHOWN = f"SELECT {SQL_NATION_PATH} AS filename, n_name AS name, CAST(n_nationkey AS VARCHAR) AS key, row_number() OVER (ORDER BY n_name DESC) AS o FROM nation WHERE n_nationkey % 4 <> 3"
_SHOW = "select name, key from n/*.md sort by name desc"
_STYLED = ("documents", STYLE_PATH, STYLE_CONTENT)
_BARE = ("documents", BARE_PATH, BARE_CONTENT)
_NATIONS = ("nation", NATION_PATH, NATION_CONTENT)
_READ_ERROR = "'could not read: not a text file'"

CASES: dict[str, Case] = {
    # -- which documents there are, and how they are read
    "src_known_extensions": Case(*_STYLED, "select k, lang from src/*", f"SELECT {SQL_PATH} AS filename, CAST(doc_id AS VARCHAR) AS k, lang FROM documents WHERE doc_id % 6 <> 4"),
    "src_patterns": Case(*_STYLED, "select k from src/[b-d]*[02468].?* src/[!a-d]*", f"SELECT {SQL_PATH} AS filename, CAST(doc_id AS VARCHAR) AS k FROM documents WHERE doc_id % 6 IN (2) OR doc_id % 6 = 5 OR (doc_id % 6 IN (1, 3) AND doc_id % 2 = 0)"),
    "src_interpreter_line": Case(*_STYLED, "select k, lang from src/run4 src/run10 src/run16", f"SELECT {SQL_PATH} AS filename, CAST(doc_id AS VARCHAR) AS k, lang FROM documents WHERE doc_id IN (4, 10, 16)"),
    "src_hidden_are_left_out": Case(*_NATIONS, "select key from n/*.md", f"SELECT {SQL_NATION_PATH} AS filename, CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE n_nationkey % 4 <> 3"),
    "src_hidden_when_asked": Case(*_NATIONS, "select key from n/*.md", f"SELECT {SQL_NATION_PATH} AS filename, CAST(n_nationkey AS VARCHAR) AS key FROM nation", options=Options(include_hidden=True)),
    "src_hidden_by_name": Case(*_NATIONS, "select key from n/.03.md n/0[01].md", f"SELECT {SQL_NATION_PATH} AS filename, CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE n_nationkey IN (0, 1, 3)"),
    "src_not_text": Case(*_BARE, "update new/*.go set a = 1", f"SELECT {SQL_BARE_PATH} AS path, {_READ_ERROR} AS why FROM documents WHERE doc_id % 5 = 4", "failed"),
    "src_star": Case(*_STYLED, "select * from src/*.js", f"SELECT {SQL_PATH} AS filename, MAP {{'k': CAST(doc_id AS VARCHAR), 'lang': lang}} AS fields FROM documents WHERE doc_id % 6 = 2"),
    # -- how they are written
    "snk_headers_of_all_styles": Case(*_STYLED, "update src/*.* set z = 1", f"SELECT {SQL_PATH} AS path, {SQL_UPDATED} AS content FROM documents WHERE doc_id % 6 <> 4", "rendered"),
    "snk_rewritten_if_unchanged": Case(*_STYLED, "update src/*.py set k = k", f"SELECT {SQL_PATH} AS path, replace({SQL_UPDATED}, '# z: 1' || chr(10), '') AS content FROM documents WHERE doc_id % 6 = 1", "rendered"),
    "snk_no_header": Case(
        *_BARE, "update new/*.* set a = 1",
        f"SELECT {SQL_BARE_PATH} AS path, CASE WHEN doc_id % 5 = 4 THEN {_READ_ERROR} ELSE 'could not write: no header; name the file explicitly or pass --lang to insert one' END AS why FROM documents WHERE doc_id % 5 <> 0", "failed",
    ),
    "snk_new_markdown_header": Case(*_BARE, "update new/*.md set a = 1", f"SELECT {SQL_BARE_PATH} AS path, '---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10) || text AS content FROM documents WHERE doc_id % 5 = 0", "rendered"),
    "snk_forced_syntax": Case(
        *_BARE, "update new/*.py new/*.rb set a = 1",
        f"""SELECT {SQL_BARE_PATH} AS path, CASE WHEN doc_id % 5 = 1 THEN '#!/usr/bin/python' || chr(10) || '# -*- coding: utf-8 -*-' || chr(10) || '# ---' || chr(10) || '# a: 1' || chr(10) || '# ---' || chr(10) || 'x = ' || doc_id || chr(10)
        ELSE '# frozen_string_literal: true' || chr(10) || '# ---' || chr(10) || '# a: 1' || chr(10) || '# ---' || chr(10) || 'puts ' || doc_id || chr(10) END AS content FROM documents WHERE doc_id % 5 IN (1, 3)""",
        "rendered", Options(language=chosen("py")),
    ),
    "snk_forced_block": Case(
        *_BARE, "update new/*.css set a = 1",
        f"SELECT {SQL_BARE_PATH} AS path, '<<---' || chr(10) || 'a: 1' || chr(10) || '--->>' || chr(10) || 'a{{top:' || doc_id || '}}' || chr(10) AS content FROM documents WHERE doc_id % 5 = 2",
        "rendered", Options(language=chosen(block_open="<<", block_close=">>")),
    ),
    # -- statements
    "stm_verbose_rows": Case(
        *_STYLED, "update src/*.md set z = k + 1, lang = upper(lang) where k",
        f"SELECT 0 AS statement, {SQL_PATH} AS filename, ['z', 'lang'] AS names, [CAST(doc_id + 1 AS VARCHAR), upper(lang)] AS cells FROM documents WHERE doc_id % 6 = 0 AND doc_id <> 0", "shown", Options(verbose=True),
    ),
    "stm_dry_run": Case(
        *_NATIONS, "update n/*.md set key = key + 100 where region = 1",
        f"SELECT 'filename,key' || chr(10) || string_agg({SQL_NATION_PATH} || ',' || (n_nationkey + 100) || chr(10), '' ORDER BY n_nationkey) AS output FROM nation WHERE n_nationkey % 4 <> 3 AND n_regionkey = 1", "csv", Options(dry_run=True, verbose=True),
    ),
    "stm_later_ones_see_earlier": Case(
        *_STYLED, "update src/*.py set k = k * 2; alter src/*.py rename k to half; select half, k from src/*.py",
        f"SELECT 2 AS statement, {SQL_PATH} AS filename, ['half', 'k'] AS names, [CAST(doc_id * 2 AS VARCHAR), ''] AS cells FROM documents WHERE doc_id % 6 = 1", "shown",
    ),
    "stm_error_ends_the_row": Case(
        *_STYLED, "update src/*.md set z = 1; update src/*.md set n:int = lang",
        f"SELECT {SQL_PATH} AS path, 'cannot cast value to int for field \"n\": cannot cast string ''' || lang || ''' to int' AS why FROM documents WHERE doc_id % 6 = 0", "failed",
    ),
    "src_nothing_named": Case(*_NATIONS, "select 1 + 2, upper('a') from none/*.md", "SELECT 'filename  expr1  expr2' || chr(10) || '--------  -----  -----' || chr(10) || '(0 rows)' || chr(10) AS output", "simple"),
    # -- order
    "srt_ties_in_order_of_documents": Case(*_NATIONS, "select key, region from n/*.md sort by region desc limit 7", f"SELECT {SQL_NATION_PATH} AS filename, CAST(n_nationkey AS VARCHAR) AS key, CAST(n_regionkey AS VARCHAR) AS region FROM nation WHERE n_nationkey % 4 <> 3 ORDER BY n_regionkey DESC, n_nationkey LIMIT 7"),
    "lim_first_documents": Case(*_NATIONS, "select key from n/*.md limit 5", f"SELECT {SQL_NATION_PATH} AS filename, CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE n_nationkey % 4 <> 3 ORDER BY n_nationkey LIMIT 5"),
    # -- output
    "out_simple": Case(*_NATIONS, _SHOW, _boxed(["filename", "name", "key"], _SHOWN), "simple"),
    "out_full": Case(*_NATIONS, _SHOW, _lined(["filename", "name", "key"], _SHOWN), "full"),
    "out_csv": Case(*_NATIONS, _SHOW, f"SELECT 'filename,name,key' || chr(10) || string_agg(filename || ',' || name || ',' || key || chr(10), '' ORDER BY o) || '(' || count(*) || ' rows)' || chr(10) AS output FROM ({_SHOWN})", "csv"),
    "out_markdown": Case(*_NATIONS, _SHOW, f"SELECT '| filename | name | key |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || filename || ' | ' || name || ' | ' || key || ' |' || chr(10), '' ORDER BY o) || '(' || count(*) || ' rows)' || chr(10) AS output FROM ({_SHOWN})", "markdown"),
    "out_hidden_columns": Case(
        *_NATIONS, "select * from n/*.md",
        f"SELECT 'filename,key' || chr(10) || string_agg({SQL_NATION_PATH} || ',' || n_nationkey || chr(10), '' ORDER BY n_nationkey) || '(' || count(*) || ' rows)' || chr(10) || '(2 more column(s) hidden; raise --max-columns to show)' || chr(10) AS output FROM nation WHERE n_nationkey % 4 <> 3",
        "csv", Options(max_columns=1),
    ),
    "out_one_row_and_two_tables": Case(
        *_NATIONS, "select name from n/00.md; update n/*.md set a = 1; select key from n/01.md",
        "SELECT 'filename,name' || chr(10) || 'n/00.md,' || max(CASE WHEN n_nationkey = 0 THEN n_name END) || chr(10) || '(1 row)' || chr(10) || chr(10) || 'filename,key' || chr(10) || 'n/01.md,1' || chr(10) || '(1 row)' || chr(10) AS output FROM nation", "csv",
    ),
    "out_long_cells_are_clipped": Case(
        "nation", NATION_PATH, r"concat('---\nname: ', n_name, '\nlong: ', repeat('ab', 20), '\n---\n')", "select long from n/*.md",
        _boxed(["filename", "long"], f"SELECT {SQL_NATION_PATH} AS filename, substr(repeat('ab', 20), 1, 29) || '…' AS long, n_nationkey AS o FROM nation WHERE n_nationkey % 4 <> 3"), "simple",
    ),
}

#: Programs that the parser takes or refuses, by the rules of words, literals and calls.
ACCEPTED = (
    "select a_b1, B2 from t", "select `from` from t", "SeLeCt a FrOm t wHeRe b LiMiT 1", "select a from t -- done",
    "select -1, - 2, 1 - -1 from t", "select upper (a) from t", "select a from t;;select b from t;", "select 'it\\'s', \"a\" from t", "update t set a:int = '1'",
    "update t set a:date = '2024-02-03'", "select 0x1F, 010, 1e3, .5 from t", "select selected, fromage from t", "select from t",
    "select upper(a, b), nosuch(a) from t", "select a from t)", "update t set a:date = 'soon'",
)
REFUSED = (
    "select a from t where", "select a b from t", "select a from t limit -1", "select 'open from t", "select a === b from t", "select a /* x */ from t",
    "update t set a:int = 'x'", "update t set a:bool = 'maybe'", "update t set a:numeric = '1x'", "alter t drop", "alter t rename a", "delete from t", "select a:color from t",
)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for text in (*ACCEPTED, *REFUSED):
        try:
            parse_program(text)
            rows.append((text, True))
        except ParseError:
            rows.append((text, False))
    return spark.createDataFrame(rows, "program string, accepted boolean")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Programs over tables that show the rules of words and literals.
LEXICAL: dict[str, tuple[str, str]] = {
    "lex_no_date_literals": ("select n_name, 2024-01-02, n_nationkey -1 from nation", "SELECT n_name, CAST(2021 AS BIGINT) AS expr2, CAST(n_nationkey - 1 AS BIGINT) AS expr3 FROM nation"),
    "lex_negative_literals": ("select n_name, -3, 2 - -n_regionkey, -n_regionkey * -2 from nation where n_regionkey > -1", "SELECT n_name, CAST(-3 AS BIGINT) AS expr2, CAST(2 + n_regionkey AS BIGINT) AS expr3, CAST(n_regionkey * 2 AS BIGINT) AS expr4 FROM nation"),
    "lex_keywords_in_any_case": ("SELECT n_name FROM nation WHERE NOT n_regionkey = 1 AND n_name LIKE '%A%' SORT BY n_name DESC LIMIT 6 -- the last of them", "SELECT n_name FROM nation WHERE n_regionkey <> 1 AND n_name LIKE '%A%' ORDER BY n_name DESC LIMIT 6"),
    "lex_calls_and_comments": ("select upper ( n_name ), -- a call\n concat(n_name , '' , 'x') -- and one more\n from nation", "SELECT upper(n_name) AS expr1, n_name || 'x' AS expr2 FROM nation"),
}


def _program(program: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Tables(spark, sf_dir).run(program)[-1]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: case.run for name, case in CASES.items()}
QUERIES |= {name: _program(program) for name, (program, _) in LEXICAL.items()}
QUERIES["lex_accepted_and_refused"] = _verdicts
ORACLE_SQL: dict[str, str] = {name: case.sql for name, case in CASES.items()} | {name: sql for name, (_, sql) in LEXICAL.items()}
ORACLE_SQL["lex_accepted_and_refused"] = "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(t)}, {str(t in ACCEPTED).lower()})" for t in (*ACCEPTED, *REFUSED)) + ") AS v(program, accepted)"
