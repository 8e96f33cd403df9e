"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java regex class and as the characters themselves.
WHITE = "[\\x20\\x09-\\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in a local session alone, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quillframe_table = path
    return out


def written() -> set[str]:
    """Paths of the tables of materialise() that are still there."""
    return {path for _, path in _written}


def forget(*tables: DataFrame | str) -> None:
    """Delete the tables behind DataFrames of materialise() (or at paths), which nothing will read any more, and free finished shuffles.

    Spark's cleaner drops a shuffle's files once the driver's garbage
    collection finds its plan unused, which may otherwise be long after.
    """
    paths = {t if isinstance(t, str) else getattr(t, "_quillframe_table", None) for t in tables}
    gone = [e for e in _written if e[1] in paths]
    for entry in gone:
        _delete(*entry)
        _written.remove(entry)
    if gone:
        gc.collect()
        gone[0][0].sparkContext._jvm.System.gc()


#: Hashes are compared with a share of this range, which stays exact for any number of rows.
_RANGE = 1 << 62


def sampled(hashed: Column, n: int, most: int) -> Column:
    """Whether a row is among about `most` of n, by a 64-bit hash of it; all are where n is no more than that."""
    return F.lit(True) if n <= most else F.pmod(hashed, F.lit(_RANGE)) < _RANGE * most // n


#: Keys that join_spread() sends to every task, at most.
HOT_KEYS = 10_000
HOT_ROWS = 1_000


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """left.join(right, keys, how) for a right side of unique keys whose column n counts the rows of left.

    Keys with more than a HOT_KEYS-th of all rows, of which there are fewer than
    HOT_KEYS, go to every task, so their rows stay where they are; n is dropped.
    Both sides should be cheap to read twice.
    """
    total = right.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    least = max(HOT_ROWS, total // HOT_KEYS)
    if not right.filter(F.col(n) > least).limit(1).count():
        return left.join(right.drop(n), keys, how)
    hot, rest = right.filter(F.col(n) > least).drop(n), right.filter(F.col(n) <= least).drop(n)
    spread = left.join(F.broadcast(hot), keys)
    others = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return spread.unionByName(others)


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    _written.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    """True for one document in five, by crc32 of the id as text; labels of such rows are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0

