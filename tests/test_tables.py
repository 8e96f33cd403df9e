"""Statements over tables: plans, oracles, mutations and streams."""

import math
import os

import pytest

import __spark_entry__ as entry_module
from quillframe import queries
from quillframe.engine import Tables
from quillframe.operators import statements
from quillframe.plans.parser import parse_query
from quillframe.streaming import over_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_against_sql(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    result = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    wanted = sorted([plain(v) for _, v in sorted(zip(columns, row))] for row in result.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert sorted([plain(v) for _, v in sorted(zip(df.columns, row))] for row in df.collect()) == wanted


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry_module.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry_module.queries()) and set(queries.ORACLE_SQL) <= set(entry_module.oracle_sql())


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = plan_of(Tables(spark, data).query("select o_orderkey from orders where o_totalprice > 1000 and o_orderstatus = 'F' and o_orderpriority like '1-%'"))
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "EqualTo(o_orderstatus,F)" in plan and "StringStartsWith(o_orderpriority,1-)" in plan
    assert "o_custkey" not in plan.rsplit("ReadSchema", 1)[1]


def test_sort_and_limit_are_a_top_k(spark, data):
    plan = plan_of(Tables(spark, data).query("select o_orderkey from orders sort by o_totalprice desc limit 3"))
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_stable_sort(spark, data):
    rows = Tables(spark, data).query("select c_custkey from customer sort by c_nationkey", stable=True).collect()
    by_nation = spark.read.parquet(f"{data}/customer.parquet").collect()
    wanted = [r.c_custkey for r in sorted(by_nation, key=lambda r: r.c_nationkey)]
    assert [r.c_custkey for r in rows] == wanted


def test_ansi_setting_comes_back(spark, data):
    before = spark.conf.get("spark.sql.ansi.enabled")
    rows = Tables(spark, data).query("select r_name, 9223372036854775807 + r_regionkey, mod(r_regionkey, 0) from region where r_regionkey = 1").collect()
    assert rows[0][1] == -(2**63) and rows[0][2] is None and spark.conf.get("spark.sql.ansi.enabled") == before


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(1, "a", ["x"], None), (2, None, None, "7"), (3, "b", [], "q")], "id bigint, s string, l array<string>, n string")


def rows(df):
    return [tuple(r) for r in df.orderBy("id").collect()]


@pytest.mark.parametrize(
    ("text", "columns", "wanted"),
    [
        ("update t set s = concat(s, '!') where id < 3", "s", [("a!",), (None,), ("b",)]),
        ("update t set l += 'x', l += ['y', 'y']", "l", [(["x", "y"],), (["x", "y"],), (["x", "y"],)]),
        ("update t set l -= 'x'", "l", [([],), (None,), ([],)]),
        ("update t set s -= 'a'", "s", [("a",), (None,), ("b",)]),
        ("update t set s += 'z' where id = 1", "s", [(["a", "z"],), (None,), (["b"],)]),
        ("update t set k:int = n where id > 1", "k", [(None,), (7,), (None,)]),
        ("update t set k = null, m", "k", [(None,)] * 3),
        ("update t set l = null where id = 1", "l", [(None,), (None,), ([],)]),
        ("update t set id = 0.5 where id = 2", "id", [(0.5,), (1.0,), (3.0,)]),
    ],
)
def test_updates(frame, text, columns, wanted):
    out = statements.mutate(frame, parse_query(text))
    assert [tuple(r) for r in out.select(columns, "id").orderBy("id").select(columns).collect()] == wanted


def test_failed_rows_keep_everything(frame):
    out = statements.mutate(frame, parse_query("update t set s = 'changed', n:int = n"))
    failed = {r.id: r._error for r in out.collect()}
    assert failed[1] and not failed[2] and failed[3]
    assert {r.id: r.s for r in out.collect()} == {1: "a", 2: "changed", 3: "b"}
    again = statements.mutate(out, parse_query("update t set s = 'later'"))
    assert {r.id: r.s for r in again.collect()} == {1: "a", 2: "later", 3: "b"}


def test_alter(frame):
    assert statements.mutate(frame, parse_query("alter t drop s, missing")).columns == ["id", "l", "n"]
    assert statements.mutate(frame, parse_query("alter t rename s to n, missing to y, id to id")).columns == ["id", "n", "l"]
    out = statements.mutate(frame, parse_query("alter t rename s to z where id = 1"))
    assert [(r.s, r.z) for r in out.orderBy("id").collect()] == [(None, "a"), (None, None), ("b", None)]


def test_scripts_and_saving(spark, data, tmp_path):
    t = Tables(spark, data)
    frames = t.run("update region set big = r_regionkey > 2; alter region rename r_name to name; select name from region where big")
    assert len(frames) == 3 and frames[-1].count() == 2
    t.save("region", str(tmp_path / "region"))
    assert set(spark.read.parquet(str(tmp_path / "region")).columns) == {"r_regionkey", "name", "big"}


def test_given_frames_and_missing_columns(spark, frame):
    t = Tables(spark, frames={"t": frame, "u": frame.select("id")})
    assert t.query("select id, s from t u").count() == 6
    assert t.query("select id from t where l >= 'x'").collect()[0].id == 1


def test_rows_without_static_kinds(spark, frame):
    t = Tables(spark, frames={"t": frame})
    out = t.query("select id, coalesce(n, id), [id, s] from t sort by coalesce(n, id) desc limit 2")
    assert [tuple(r) for r in out.collect()] == [(3, "q", "[3, b]"), (2, "7", "[2, ]")]


def test_streams(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    (tmp_path / "in").mkdir()
    os.symlink(f"{data}/events.parquet", tmp_path / "in/events.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    text = "select event_id, round(value * 2, 1) from events where event_type = 'click' and value > 1"
    q = over_stream(stream, text).writeStream.format("memory").queryName("clicks").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("clicks").count() == Tables(spark, data).query(text).count()
    with pytest.raises(ValueError):
        over_stream(stream, "select event_id from events limit 3")


def test_mutations_without_static_kinds(spark, frame):
    t = Tables(spark, frames={"t": frame})
    out = t.run("update t set mix = [id, s], k:int = n where s or n")[0].orderBy("id").collect()
    assert [(r.id, r.l, r.mix, r.k, bool(r._error)) for r in out] == [(1, ["x"], None, None, True), (2, None, "[2, ]", "7", False), (3, [], None, None, True)]
    t.run("update t set l += [1, 'x', id]")
    assert t.query("select l from t where id = 2").collect()[0].l == "[1, x, 2]"
