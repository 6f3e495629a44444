"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_OWN_DIRS: dict[str, str] = {}
#: Tables of the innermost scope, of this thread alone.
_SCOPE: ContextVar[list[str] | None] = ContextVar("tables of the scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set, one of our own if the session runs
    on this machine alone, as in tests; on a cluster that is an error, as executors could not read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = context.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="tideglass-")
    return _OWN_DIRS[app]


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tideglass-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lost executor re-reads files
    instead of recomputing, and what follows starts from known sizes."""
    path = fresh_path(df.sparkSession)
    owned(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def owned(path: str) -> None:
    """A table that goes with the scope it is made in, if there is one."""
    if (paths := _SCOPE.get()) is not None:
        paths.append(path)


def discard(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`durable` writes inside are deleted at the end: what is read from them has to be
    written by then. Outside of any scope they stay, as results are read after the call that made them."""
    paths: list[str] = []
    before = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        for path in paths:
            discard(spark, path)


def with_fact(rows: DataFrame, facts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` inner-joined with ``facts`` (a table, one row per key), whose column ``n`` tells how many of ``rows``
    have that key; ``n`` is dropped.

    A key that very many rows have would be one task of a shuffled join. Keys of over a thousand rows, and over a
    100,000th part of all, are so at most 100,000 keys, whatever the input: these facts are broadcast, and their
    rows aren't shuffled. The others are joined by their keys. ``rows`` is read twice, so it should be a table too.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    bound = max(1000, total // 100_000)
    few, many = facts.where(F.col(n) <= bound).drop(n), facts.where(F.col(n) > bound).drop(n)
    hot = many.select(*keys)
    cold_rows = rows.join(F.broadcast(hot), keys, "left_anti")
    return cold_rows.join(few, keys).unionByName(rows.join(F.broadcast(many), keys))



def running_sums(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ``sum_*`` for each of ``values`` (whole numbers): its sum over the rows of ``by`` up to this one by ``order``.

    Rows are dealt by range, so that one key with very many rows is spread over partitions; what stands in earlier
    partitions of a key is one row per partition and key, and only a partition's first key has any.
    """
    dealt = durable(rows.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()))
    own = W.partitionBy("part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    past = W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("part", *by).agg(*[F.sum(v).alias(v) for v in values])
    earlier = durable(sums.select("part", *[F.col(c).alias(f"{c}_k") for c in by], *[F.sum(v).over(past).alias(f"past_{v}") for v in values]).where(f"past_{values[0]} is not null"))
    same = [dealt["part"] == earlier["part"], *[dealt[c].eqNullSafe(earlier[f"{c}_k"]) for c in by]]
    zero = F.lit(0).cast("long")
    found = dealt.join(F.broadcast(earlier), same, "left").drop(earlier["part"])
    return found.select(*rows.columns, *[(F.sum(v).over(own) + F.coalesce(f"past_{v}", zero)).alias(f"sum_{v}") for v in values])
