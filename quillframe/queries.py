"""Queries of the dialect over the benchmark tables, each with the SQL that gives the same rows.

A query is a SELECT, or a script whose last statement's table is the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import document_queries
from .engine import Documents, Tables

#: name -> (program in the dialect, SQL)
CATALOG: dict[str, tuple[str, str]] = {
    # -- projection, filters, literals
    "flt01_top_discounted": (
        "select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_discount >= 0.05 sort by l_extendedprice desc, l_orderkey, l_linenumber limit 10",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice FROM lineitem WHERE l_discount >= 0.05 ORDER BY l_extendedprice DESC NULLS FIRST, l_orderkey, l_linenumber LIMIT 10",
    ),
    "flt01_where_truthy": ("select n_name, n_regionkey from nation where n_regionkey", "SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation WHERE n_regionkey <> 0"),
    "prj01_expression_names": ("select l_quantity * l_tax, l_orderkey, 1 + 2 from lineitem", "SELECT l_quantity * l_tax AS expr1, l_orderkey, CAST(3 AS BIGINT) AS expr3 FROM lineitem"),
    "prj02_star": ("select * from part where p_size = 7", "SELECT p_brand, p_name, p_partkey, p_retailprice, CAST(p_size AS BIGINT) AS p_size, p_type FROM part WHERE p_size = 7"),
    "fld01_missing_field": ("select r_name, nothing from region", "SELECT r_name, CAST(NULL AS VARCHAR) AS nothing FROM region"),
    "fld02_failed_cast_is_null": ("select p_partkey, p_name:int from part", "SELECT p_partkey, CAST(NULL AS BIGINT) AS p_name FROM part"),
    "fld02_temporal_kinds": (
        "select event_id, ts:date from events",
        "SELECT event_id, CASE WHEN ts = date_trunc('day', ts) THEN CAST(ts AS DATE) END AS ts FROM events",
    ),
    "fld03_quoted_names": ("select `p_name`, `p_size` from part where `p_size` > 45", "SELECT p_name, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size > 45"),
    "lit_numbers": ("select r_name, 0x1F + 010, -5 - -3, 1.5e2 from region", "SELECT r_name, CAST(39 AS BIGINT) AS expr2, CAST(-2 AS BIGINT) AS expr3, CAST(150 AS DOUBLE) AS expr4 FROM region"),
    "lit_strings": ("select r_name, 'a\\tb', r'a\\tb', \"it's\" from region", "SELECT r_name, 'a' || chr(9) || 'b' AS expr2, 'a\\tb' AS expr3, 'it''s' AS expr4 FROM region"),
    "lit06_list": ("select p_partkey, [p_size, 1, 2] from part where p_size < 4", "SELECT p_partkey, [CAST(p_size AS BIGINT), 1, 2] AS expr2 FROM part WHERE p_size < 4"),
    # -- logic and comparison
    "log01_or": ("select p_partkey from part where p_size = 1 or p_brand = 'Brand#2'", "SELECT p_partkey FROM part WHERE p_size = 1 OR p_brand = 'Brand#2'"),
    "log02_and": ("select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice > 300000", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000"),
    "log03_not_null": ("select p_partkey, not p_name:int, not p_size from part", "SELECT p_partkey, true AS expr2, p_size = 0 AS expr3 FROM part"),
    "cmp01_null_equals_null": ("select p_partkey, p_name:int = null, p_size = null, null = null from part", "SELECT p_partkey, true AS expr2, false AS expr3, true AS expr4 FROM part"),
    "cmp01_across_kinds": ("select p_partkey from part where p_size = '7'", "SELECT p_partkey FROM part WHERE p_size = 7"),
    "cmp02_not_equal": ("select p_partkey from part where p_name:int != p_size and p_brand != 'Brand#1'", "SELECT p_partkey FROM part WHERE p_brand <> 'Brand#1'"),
    "cmp03_less": ("select l_orderkey, l_quantity from lineitem where l_quantity < 3", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 3"),
    "cmp04_less_or_equal": ("select l_orderkey, l_tax <= 0.02 from lineitem", "SELECT l_orderkey, l_tax <= 0.02 AS expr2 FROM lineitem"),
    "cmp05_greater": ("select c_custkey, c_acctbal > 0 from customer", "SELECT c_custkey, c_acctbal > 0 AS expr2 FROM customer"),
    "cmp06_strings_have_no_order": ("select p_partkey, p_name > 'm', l_none < 3 from part", "SELECT p_partkey, false AS expr2, false AS expr3 FROM part"),
    "cmp07_list_equality": (
        "select p_partkey, split(p_name, ' ') = split(concat(p_name, ' '), ' '), split(p_name, ' ') = split(p_name, ' ') from part",
        "SELECT p_partkey, false AS expr2, true AS expr3 FROM part",
    ),
    "cmp08_membership": ("select p_partkey from part where split(p_name, ' ') >= 'small'", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'small')"),
    "cmp09_membership_mirrored": ("select o_orderkey from orders where o_orderstatus <= ['F', 'P']", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    "cmp10_list_against_scalar": ("select p_partkey, split(p_name, ' ') = 'small', split(p_name, ' ') != 'small', [1] < [2] from part", "SELECT p_partkey, false AS expr2, false AS expr3, false AS expr4 FROM part"),
    # -- sets, patterns, arithmetic
    "set01_intersection": (
        "select p_partkey, split(concat(p_name, ' ', p_name), ' ') <=> ['small', 'ring', 'bolt'] from part",
        "SELECT p_partkey, list_filter(string_split(p_name || ' ' || p_name, ' '), lambda x: x IN ('small', 'ring', 'bolt')) AS expr2 FROM part",
    ),
    "set02_union": (
        "select p_partkey, split(p_name, ' ') >=< ['small', 'new', 'new'] from part",
        "SELECT p_partkey, string_split(p_name, ' ') || list_filter(['small', 'new'], lambda x: NOT list_contains(string_split(p_name, ' '), x)) AS expr2 FROM part",
    ),
    "mat01_like_keeps_to_lines": ("select doc_id from documents where text like '%the%'", "SELECT doc_id FROM documents WHERE regexp_full_match(text, '[^\\n]*the[^\\n]*')"),
    "mat01_like_prefix": ("select p_partkey, p_name from part where p_name like 'small%'", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small')"),
    "mat02_not_like": ("select p_partkey from part where p_name not like '%ring' and p_type not like '_MALL'", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%ring' AND p_type NOT LIKE '_MALL'"),
    "mat03_ilike": ("select p_partkey from part where p_type ilike 'econ%' or p_name ilike 'RED%'", "SELECT p_partkey FROM part WHERE p_type ILIKE 'econ%' OR p_name ILIKE 'RED%'"),
    "mat04_not_ilike": ("select p_partkey from part where p_type not ilike 'econ%'", "SELECT p_partkey FROM part WHERE p_type NOT ILIKE 'econ%'"),
    "mat05_regexp": ("select o_orderkey, o_orderpriority from orders where o_orderpriority regexp '^[12]-'", "SELECT o_orderkey, o_orderpriority FROM orders WHERE regexp_matches(o_orderpriority, '^[12]-')"),
    "mat06_not_regexp": ("select c_custkey from customer where c_mktsegment not regexp 'U.*E' and c_name regexp '('", "SELECT c_custkey FROM customer WHERE false"),
    "ari01_add": ("select l_orderkey, l_linenumber + 1, l_quantity + 0.5, l_returnflag + 1 from lineitem", "SELECT l_orderkey, CAST(l_linenumber + 1 AS BIGINT) AS expr2, l_quantity + 0.5 AS expr3, CAST(NULL AS DOUBLE) AS expr4 FROM lineitem"),
    "ari02_subtract": ("select l_orderkey, l_extendedprice - l_discount from lineitem", "SELECT l_orderkey, l_extendedprice - l_discount AS expr2 FROM lineitem"),
    "ari03_multiply": ("select l_orderkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) from lineitem", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS expr2 FROM lineitem"),
    "ari04_divide": ("select l_orderkey, l_linenumber / 2, l_quantity / (l_linenumber - 1) from lineitem", "SELECT l_orderkey, l_linenumber / 2 AS expr2, CASE WHEN l_linenumber <> 1 THEN l_quantity / (l_linenumber - 1) END AS expr3 FROM lineitem"),
    "ari05_negate": ("select c_custkey, -c_acctbal, -c_nationkey, -c_name from customer", "SELECT c_custkey, -c_acctbal AS expr2, CAST(-c_nationkey AS BIGINT) AS expr3, CAST(NULL AS VARCHAR) AS expr4 FROM customer"),
    # -- sorting and limits
    "srt01_expressions": ("select c_custkey, c_acctbal from customer sort by c_nationkey * 2 desc, c_acctbal, c_custkey limit 40", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_nationkey * 2 DESC NULLS FIRST, c_acctbal, c_custkey LIMIT 40"),
    "srt02_nulls_first_downwards": (
        "select l_orderkey, l_linenumber, l_quantity from lineitem sort by l_quantity / (l_linenumber - 1) desc, l_orderkey, l_linenumber, l_quantity limit 25",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem ORDER BY CASE WHEN l_linenumber <> 1 THEN l_quantity / (l_linenumber - 1) END DESC NULLS FIRST, l_orderkey, l_linenumber, l_quantity LIMIT 25",
    ),
    "srt02_nulls_last_upwards": (
        "select l_orderkey, l_linenumber, l_quantity from lineitem sort by l_quantity / (l_linenumber - 1), l_orderkey, l_linenumber, l_quantity limit 400",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem ORDER BY CASE WHEN l_linenumber <> 1 THEN l_quantity / (l_linenumber - 1) END NULLS LAST, l_orderkey, l_linenumber, l_quantity LIMIT 400",
    ),
    "lim01_zero_is_all": ("select r_name from region limit 0", "SELECT r_name FROM region"),
    "top01_top_k": ("select o_orderkey, o_totalprice from orders sort by o_totalprice desc, o_orderkey limit 15", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15"),
    # -- strings
    "str01_lower": ("select p_partkey, lower(p_type) from part", "SELECT p_partkey, lower(p_type) AS expr2 FROM part"),
    "str02_upper": ("select p_partkey, upper(p_name) from part", "SELECT p_partkey, upper(p_name) AS expr2 FROM part"),
    "str03_length": ("select doc_id, length(text), length(doc_id) from documents", "SELECT doc_id, length(text) AS expr2, length(CAST(doc_id AS VARCHAR)) AS expr3 FROM documents"),
    "str04_substr": (
        "select p_partkey, substr(p_name, -4, 3), substr(p_name, 0, 2), substr(p_name, 3), substr(p_name, 50), substr(p_name, 2, -1) from part",
        "SELECT p_partkey, substr(p_name, CAST(greatest(1, length(p_name) - 3) AS BIGINT), 3) AS expr2, substr(p_name, 1, 2) AS expr3, substr(p_name, 3) AS expr4, '' AS expr5, '' AS expr6 FROM part",
    ),
    "str05_starts_with": ("select p_partkey from part where starts_with(p_name, 're')", "SELECT p_partkey FROM part WHERE starts_with(p_name, 're')"),
    "str06_ends_with": ("select p_partkey, ends_with(p_name, 'bolt') from part", "SELECT p_partkey, ends_with(p_name, 'bolt') AS expr2 FROM part"),
    "str07_contains_substr": ("select doc_id from documents where contains_substr(text, 'and')", "SELECT doc_id FROM documents WHERE contains(text, 'and')"),
    "str08_trim": ("select p_partkey, trim(concat('\\t ', p_name, ' \\n')), trim(p_name, 'sgr') from part", "SELECT p_partkey, p_name AS expr2, trim(p_name, 'sgr') AS expr3 FROM part"),
    "str09_ltrim": ("select p_partkey, ltrim(p_name, 'sma') from part", "SELECT p_partkey, ltrim(p_name, 'sma') AS expr2 FROM part"),
    "str10_rtrim": ("select p_partkey, rtrim(p_name, 'ring') from part", "SELECT p_partkey, rtrim(p_name, 'ring') AS expr2 FROM part"),
    "str11_replace": ("select p_partkey, replace(p_name, ' ', '--') from part", "SELECT p_partkey, replace(p_name, ' ', '--') AS expr2 FROM part"),
    "str12_split": ("select p_partkey, split(p_name, ' '), split(o_none, ',') from part", "SELECT p_partkey, string_split(p_name, ' ') AS expr2, CAST(NULL AS VARCHAR) AS expr3 FROM part"),
    "str13_concat": ("select p_partkey, concat(p_brand, '/', p_size), concat(p_name, p_name:int) from part", "SELECT p_partkey, p_brand || '/' || p_size AS expr2, CAST(NULL AS VARCHAR) AS expr3 FROM part"),
    "str14_regexp_contains": ("select c_custkey, regexp_contains(c_mktsegment, '^B.*G$') from customer", "SELECT c_custkey, regexp_matches(c_mktsegment, '^B.*G$') AS expr2 FROM customer"),
    "str15_regexp_extract": (
        "select o_orderkey, regexp_extract(o_orderpriority, '([0-9])-(.*)'), regexp_extract(o_orderpriority, '[A-Z]+'), regexp_extract(o_orderpriority, 'zzz') from orders",
        "SELECT o_orderkey, regexp_extract(o_orderpriority, '([0-9])-(.*)', 1) AS expr2, CASE WHEN regexp_matches(o_orderpriority, '[A-Z]+') THEN regexp_extract(o_orderpriority, '[A-Z]+') END AS expr3, CAST(NULL AS VARCHAR) AS expr4 FROM orders",
    ),
    "str16_to_string": ("select p_partkey, to_string(p_size), to_string(p_size > 10) from part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS expr2, CAST(p_size > 10 AS VARCHAR) AS expr3 FROM part"),
    # -- numbers
    "num01_abs": ("select c_custkey, abs(c_acctbal), abs(c_nationkey - 10), abs(c_name) from customer", "SELECT c_custkey, abs(c_acctbal) AS expr2, CAST(abs(c_nationkey - 10) AS BIGINT) AS expr3, CAST(NULL AS DOUBLE) AS expr4 FROM customer"),
    "num02_ceil": ("select o_orderkey, ceil(o_totalprice) from orders", "SELECT o_orderkey, CAST(ceil(o_totalprice) AS BIGINT) AS expr2 FROM orders"),
    "num03_floor": ("select c_custkey, floor(c_acctbal), floor(c_custkey) from customer", "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS expr2, c_custkey AS expr3 FROM customer"),
    "num04_round": ("select l_orderkey, round(l_extendedprice * l_discount, 2), round(l_quantity / 4) from lineitem", "SELECT l_orderkey, round(l_extendedprice * l_discount * 100) / 100 AS expr2, round(l_quantity / 4) AS expr3 FROM lineitem"),
    "num05_mod": ("select o_orderkey, mod(o_orderkey, 7), mod(-o_orderkey, 3), mod(o_orderkey, 0) from orders", "SELECT o_orderkey, o_orderkey % 7 AS expr2, (-o_orderkey) % 3 AS expr3, CAST(NULL AS BIGINT) AS expr4 FROM orders"),
    "num06_sqrt": ("select l_orderkey, sqrt(l_quantity) from lineitem", "SELECT l_orderkey, sqrt(l_quantity) AS expr2 FROM lineitem"),
    "num07_pow": ("select l_orderkey, pow(l_quantity, 2) from lineitem", "SELECT l_orderkey, l_quantity * l_quantity AS expr2 FROM lineitem"),
    "num08_greatest": ("select l_orderkey, greatest(l_quantity, l_linenumber, null), greatest(l_linenumber, 4) from lineitem", "SELECT l_orderkey, greatest(l_quantity, l_linenumber) AS expr2, CAST(greatest(l_linenumber, 4) AS BIGINT) AS expr3 FROM lineitem"),
    "num09_least": ("select l_orderkey, least(l_quantity, 10, l_linenumber) from lineitem", "SELECT l_orderkey, CAST(least(l_quantity, 10, l_linenumber) AS DOUBLE) AS expr2 FROM lineitem"),
    "num10_coalesce": ("select p_partkey, coalesce(p_name:int, p_size), coalesce(nothing, p_name) from part", "SELECT p_partkey, CAST(p_size AS BIGINT) AS expr2, p_name AS expr3 FROM part"),
    # -- lists
    "lst01_array_length": ("select p_partkey, array_length(split(p_name, ' ')), array_length(p_size), array_length(embedding) from part", "SELECT p_partkey, len(string_split(p_name, ' ')) AS expr2, CAST(1 AS BIGINT) AS expr3, CAST(NULL AS VARCHAR) AS expr4 FROM part"),
    "lst02_array_contains": ("select vec_id, array_length(embedding), array_contains([1, 3, 5], label) from embeddings", "SELECT vec_id, len(embedding) AS expr2, label IN (1, 3, 5) AS expr3 FROM embeddings"),
    "lst03_array_concat": ("select p_partkey, array_concat(split(p_name, ' '), p_type, ['x']) from part", "SELECT p_partkey, string_split(p_name, ' ') || [p_type, 'x'] AS expr2 FROM part"),
    "lst04_distinct": (
        "select p_partkey, distinct(split(concat(p_name, ' ', p_name, ' z'), ' ')) from part",
        "SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN [split_part(p_name, ' ', 1), 'z'] ELSE string_split(p_name, ' ') || ['z'] END AS expr2 FROM part",
    ),
    "lst05_array_to_string": ("select p_partkey, array_to_string(split(p_name, ' '), '+'), array_to_string([p_name, p_name:int], '-') from part", "SELECT p_partkey, replace(p_name, ' ', '+') AS expr2, CAST(NULL AS VARCHAR) AS expr3 FROM part"),
    # -- dates
    "dat02_year": ("select o_orderkey, year(o_orderdate), year('2024-05-06') from orders", "SELECT o_orderkey, year(o_orderdate) AS expr2, CAST(2024 AS BIGINT) AS expr3 FROM orders"),
    "dat03_month": ("select event_id, month(ts) from events", "SELECT event_id, month(ts) AS expr2 FROM events"),
    "dat04_day": ("select event_id, day(ts), day(event_type) from events", "SELECT event_id, day(ts) AS expr2, CAST(NULL AS BIGINT) AS expr3 FROM events"),
    "dat05_date_diff": (
        "select event_id, date_diff(ts, '2023-06-15'), date_diff('2023-06-15', ts) from events",
        "SELECT event_id, CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2023-06-15')) / 86400000000.0) AS BIGINT) AS expr2, CAST(trunc((epoch_us(TIMESTAMP '2023-06-15') - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS expr3 FROM events",
    ),
    "dat_to_string": (
        "select event_id, to_string(ts), ts:datetime = to_string(ts) from events",
        "SELECT event_id, CASE WHEN ts = date_trunc('day', ts) THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS expr2, ts <> date_trunc('day', ts) AS expr3 FROM events",
    ),
    "dat01_today": ("select r_name, date_diff(today(), today()), today() = today() from region", "SELECT r_name, CAST(0 AS BIGINT) AS expr2, true AS expr3 FROM region"),
    # -- casts
    "cast_between_kinds": (
        "select p_partkey, p_size:string, concat(p_size, '.5'), p_retailprice:int from part",
        "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_size || '.5' AS expr3, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(p_retailprice AS BIGINT) END AS p_retailprice FROM part",
    ),
    # -- several tables, mutations, scripts
    "src_two_tables": ("select n_name, r_name from nation region nation", "SELECT n_name, CAST(NULL AS VARCHAR) AS r_name FROM nation UNION ALL SELECT NULL, r_name FROM region"),
    "asg01_set": ("update part set p_size = p_size * 2, p_name = upper(p_name) where p_size > 25", "SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS p_name, p_brand, p_type, CAST(CASE WHEN p_size > 25 THEN p_size * 2 ELSE p_size END AS BIGINT) AS p_size, p_retailprice FROM part"),
    "asg02_cast_failure_keeps_row": (
        "update part set p_type = 'changed', n:int = p_name where p_size > 25",
        "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, CAST(NULL AS BIGINT) AS n, CASE WHEN p_size > 25 THEN 'cannot cast value to int for field \"n\"' END AS _error FROM part",
    ),
    "asg03_cast_in_place": ("update region set r_regionkey:string", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name, CAST(NULL AS VARCHAR) AS _error FROM region"),
    "asg04_list_add": ("update part set tags += p_brand, tags += [p_type, p_brand]", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, [p_brand, p_type] AS tags FROM part"),
    "asg05_list_remove": ("update part set tags = split(p_name, ' '), tags -= ['small', 'ring']", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('small', 'ring')) AS tags FROM part"),
    "stm03_in_order": ("update part set a = p_size, b = a + 1, a = b * 10", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, CAST((p_size + 1) * 10 AS BIGINT) AS a, CAST(p_size + 1 AS BIGINT) AS b FROM part"),
    "stm04_drop": ("alter customer drop c_name, c_acctbal, c_none", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"),
    "stm04_drop_where": ("alter customer drop c_name where c_acctbal < 0", "SELECT c_custkey, CASE WHEN NOT c_acctbal < 0 THEN c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "stm05_rename": ("alter supplier rename s_name to name, s_acctbal to s_suppkey", "SELECT s_acctbal AS s_suppkey, s_name AS name, s_nationkey FROM supplier"),
    "stm05_rename_where": ("alter supplier rename s_name to name where s_acctbal > 0", "SELECT s_suppkey, CASE WHEN NOT s_acctbal > 0 THEN s_name END AS s_name, s_nationkey, s_acctbal, CASE WHEN s_acctbal > 0 THEN s_name END AS name FROM supplier"),
    "stm06_script": (
        "update part set p_size = p_size + 1; -- a comment\n alter part rename p_size to size; select p_partkey, size from part where size > 40",
        "SELECT p_partkey, CAST(p_size + 1 AS BIGINT) AS size FROM part WHERE p_size + 1 > 40",
    ),
    "rowwise_mixed_list": ("select p_partkey, [p_name, p_size] from part where [p_name, p_size] >= 7", "SELECT p_partkey, '[' || p_name || ', ' || p_size || ']' AS expr2 FROM part WHERE p_size = 7"),
}

def runner(program: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Tables(spark, sf_dir).run(program)[-1]

    return run


CONTENT = (
    "concat('docs/', lang, '/', doc_id, '.md') AS path",
    "concat('---\ntitle: \"', source, '-', doc_id, '\"\nn: ', doc_id, '\ntags: [', lang, ', x]\n', if(doc_id % 3 = 0, 'draft: true\n', ''), '---\n', text) AS content",
)

#: name -> (program over documents with headers, SQL). "rendered" gives the changed documents.
DOCUMENTS: dict[str, tuple[str, str]] = {
    "doc_select": (
        "select title, n * 2, tags from docs/*/*.md where draft and n > 10 sort by n desc limit 50",
        "SELECT 'docs/' || lang || '/' || doc_id || '.md' AS filename, source || '-' || doc_id AS title, CAST(doc_id * 2 AS VARCHAR) AS expr2, '[' || lang || ', x]' AS tags FROM documents WHERE doc_id % 3 = 0 AND doc_id > 10 ORDER BY doc_id DESC LIMIT 50",
    ),
    "doc_membership": (
        "select from docs/*/*.md where tags >= 'de' and not draft",
        "SELECT 'docs/' || lang || '/' || doc_id || '.md' AS filename FROM documents WHERE lang = 'de' AND doc_id % 3 <> 0",
    ),
    "doc_update_rendered": (
        "update docs/en/*.md set tags += 'new', n = null; alter docs/*/*.md drop title where n = null and missing = null",
        """SELECT 'docs/' || lang || '/' || doc_id || '.md' AS path, '---' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'draft: true' || chr(10) ELSE '' END || 'n: null' || chr(10) || 'tags:' || chr(10)
        || '  - ' || lang || chr(10) || '  - x' || chr(10) || '  - new' || chr(10) || '---' || chr(10) || text AS content FROM documents WHERE lang = 'en'""",
    ),
}


def document_runner(program: str, rendered: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents = Documents(spark, content=spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*CONTENT))
        return documents.rendered(program) if rendered else documents.query(program, ordered=False)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: runner(program) for name, (program, _) in CATALOG.items()}
QUERIES |= {name: document_runner(program, name.endswith("rendered")) for name, (program, _) in DOCUMENTS.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in (CATALOG | DOCUMENTS).items()}
QUERIES |= document_queries.QUERIES
ORACLE_SQL |= document_queries.ORACLE_SQL
