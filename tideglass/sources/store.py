"""Price store: batches are appended as parts, merged into versions, and the last batch wins.

A store is a folder. ``parts/batch_id=N`` are appended batches. ``versions/NAME/bucket=B`` hold merged rows, never changed
once written. ``manifests/N`` names the folder of each bucket and the batches that are merged in them; the highest N counts.
A manifest appears by one rename that fails if its number is taken, so a reader sees the whole new version or the whole old one,
and of two writers one gives up.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .landing import keep_last
from .shared import discard

NOTHING = {"number": 0, "buckets": {}, "before": [], "merged": [], "streams": {}}


def month(date: Column) -> Column:
    """The bucket of a row of prices."""
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("none"))


def append_batch(rows: DataFrame, parts: str, batch_id: int) -> None:
    """Rows keep their order within the batch in ``seq`` if they have none. Each batch is a folder of its own, so
    one that is written again, as after a failure, takes its own place."""
    out = rows if "seq" in rows.columns else rows.withColumn("seq", F.monotonically_increasing_id())
    out.write.mode("overwrite").parquet(f"{parts}/batch_id={int(batch_id)}")


def union_sources(final: DataFrame | None, parts: DataFrame | None) -> DataFrame | None:
    """What was finalised before (as batch -1), then parts in the order of their batches."""
    old = None if final is None else final.withColumn("batch_id", F.lit(-1).cast("long")).withColumn("seq", F.lit(0).cast("long"))
    new = None if parts is None else parts.withColumn("batch_id", F.col("batch_id").cast("long"))
    if old is None or new is None:
        return new if old is None else old
    return old.unionByName(new, allowMissingColumns=True)


def order_parts(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`union_sources` with ``place``: their order within market and day, old ones first."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy("market_id", "date").orderBy("batch_id", "seq")))


def done_ids(rows: DataFrame) -> DataFrame:
    return rows.select("market_id").distinct()


def latest(rows: DataFrame) -> DataFrame:
    return keep_last(rows, ["market_id", "date"], ["batch_id", "seq"])


# folders and manifests


def _names(spark: SparkSession, path: str) -> list[str]:
    """What stands in a folder; nothing if there is none. For folders of few entries: batches, versions, manifests."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def manifest(spark: SparkSession, root: str) -> dict:
    """The manifest that counts: ``number``, folder by bucket in ``buckets``, folders of the version ``before``, ids of the ``merged``
    batches that may still be there, and the last micro-batch of each of ``streams``."""
    numbers = [int(n) for n in _names(spark, f"{root}/manifests") if n.isdigit()]
    if not numbers:
        return NOTHING
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/{max(numbers)}")
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, new: dict) -> None:
    """Let ``new`` count from now on; an error if another writer has published that number."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    made, at = (hadoop.Path(f"{root}/manifests/{n}") for n in (f".{uuid.uuid4().hex}", new["number"]))
    fs = made.getFileSystem(conf)
    stream = fs.create(made, False)
    stream.write(bytearray(json.dumps(new).encode()))
    stream.close()
    no_options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(made, at, no_options)


def batches(spark: SparkSession, root: str) -> list[int]:
    """Ids of the appended batches whose folders are there."""
    return sorted(int(n.removeprefix("batch_id=")) for n in _names(spark, f"{root}/parts") if n.startswith("batch_id="))


def next_batch(spark: SparkSession, root: str) -> int:
    """An id above those of all batches, merged ones too, whatever gaps there are."""
    return max([*batches(spark, root), *manifest(spark, root)["merged"]], default=-1) + 1


def append(spark: SparkSession, root: str, rows: DataFrame) -> int:
    """``rows`` as a batch of its own; its id."""
    n = next_batch(spark, root)
    append_batch(rows, f"{root}/parts", n)
    return n


def _parts(spark: SparkSession, root: str, ids: list[int]) -> DataFrame | None:
    return spark.read.option("basePath", f"{root}/parts").parquet(*[f"{root}/parts/batch_id={n}" for n in ids]) if ids else None


def _read(spark: SparkSession, root: str, folders: dict[str, str]) -> DataFrame | None:
    if not folders:
        return None
    return spark.read.parquet(*[f"{root}/{folders[b]}" for b in sorted(folders)])


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of the version that counts now; a later one doesn't change what this reads."""
    return _read(spark, root, manifest(spark, root)["buckets"])


def sources(spark: SparkSession, root: str, legacy: DataFrame | None = None) -> DataFrame | None:
    """Everything stored: the version that counts (before there is one, ``legacy``) and batches that aren't in it."""
    at = manifest(spark, root)
    old = _read(spark, root, at["buckets"])
    return union_sources(legacy if old is None else old, _parts(spark, root, [n for n in batches(spark, root) if n not in at["merged"]]))


def _last_batch(old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    return latest(union_sources(old, new))


def _merge(spark: SparkSession, root: str, at: dict, parts: DataFrame | None, legacy: DataFrame | None, bucket: Callable[[Column], Column], merge: Callable = _last_batch) -> dict[str, str]:
    """Folders by bucket with ``parts`` merged in. Only buckets that they touch are read and written, in files of about the
    advised size however many rows a bucket has; the others keep their folders."""
    own = bucket(F.col("date"))
    old = legacy
    if at["number"]:
        touched = {r[0] for r in parts.select(own).distinct().collect()}
        old = _read(spark, root, {b: f for b, f in at["buckets"].items() if b in touched})
    name = f"versions/{at['number'] + 1}-{uuid.uuid4().hex}"
    merge(old, parts).withColumn("bucket", own).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{root}/{name}")
    return at["buckets"] | {n.removeprefix("bucket="): f"{name}/{n}" for n in _names(spark, f"{root}/{name}") if n.startswith("bucket=")}


def write_version(spark: SparkSession, root: str, legacy: DataFrame | None = None, bucket: Callable[[Column], Column] = month) -> dict | None:
    """Merge batches that aren't in the version that counts into a new one, and give its manifest; it counts once that is
    published. None if there is nothing new."""
    at = manifest(spark, root)
    there = batches(spark, root)
    ids = [n for n in there if n not in at["merged"]]
    if not ids and (legacy is None or at["number"]):
        return None
    return _next(at, _merge(spark, root, at, _parts(spark, root, ids), legacy, bucket), merged=there)


def _next(at: dict, buckets: dict[str, str], **changes) -> dict:
    return at | {"number": at["number"] + 1, "buckets": buckets, "before": sorted(at["buckets"].values())} | changes


def upsert(spark: SparkSession, root: str, rows: DataFrame, stream: str, n: int, bucket: Callable[[Column], Column] = month) -> None:
    """Merge micro-batch ``n`` of a stream into the buckets it touches and publish that; the last to come wins."""
    new = rows if "seq" in rows.columns else rows.withColumn("seq", F.monotonically_increasing_id())
    merge_batch(spark, root, new.withColumn("batch_id", F.lit(0)), stream, n, bucket)


def merge_batch(spark: SparkSession, root: str, rows: DataFrame, stream: str, n: int, bucket: Callable[[Column], Column] = month, merge: Callable = _last_batch, **notes) -> None:
    """Micro-batch ``n`` of a stream by ``merge`` (of a bucket's old rows, or None, and the new ones). A micro-batch that comes
    again, as after a failure, is passed over if it is published already; ``stream`` names the stream for that. ``notes`` are kept
    with it in the manifest."""
    at = manifest(spark, root)
    if n <= at["streams"].get(stream, -1):
        return
    if notes or not rows.isEmpty():
        buckets = at["buckets"] if rows.isEmpty() else _merge(spark, root, at, rows, None, bucket, merge)
        publish(spark, root, _next(at, buckets, streams=at["streams"] | {stream: n}, **notes))
    clean(spark, root)


def clean(spark: SparkSession, root: str) -> None:
    """Delete merged batches, and the folders and manifests that neither the version that counts nor the one before it
    names, so that readers of the one before can end."""
    at = manifest(spark, root)
    for n in set(batches(spark, root)) & set(at["merged"]):
        discard(spark, f"{root}/parts/batch_id={n}")
    for name in _names(spark, f"{root}/manifests"):
        if not name.isdigit() or int(name) < at["number"] - 1:
            discard(spark, f"{root}/manifests/{name}")
    named = {*at["buckets"].values(), *at["before"]}
    for name in _names(spark, f"{root}/versions"):
        if int(name.split("-")[0]) > at["number"]:
            continue  # of a writer that hasn't published yet
        folders = {f"versions/{name}/{x}" for x in _names(spark, f"{root}/versions/{name}") if x.startswith("bucket=")}
        for gone in folders - named if folders & named else [f"versions/{name}"]:
            discard(spark, f"{root}/{gone}")


def finalize(spark: SparkSession, root: str, legacy: DataFrame | None = None, bucket: Callable[[Column], Column] = month) -> DataFrame | None:
    """Merge what was appended into a new version, publish it, delete what is merged; the rows that count then.

    ``legacy`` are prices from before the store, older than all batches; once there is a version they are in it. A run that stops before
    it publishes changes nothing and leaves a folder that the next one deletes; one that stops after it has only
    left to delete. Nothing stored: None.
    """
    new = write_version(spark, root, legacy, bucket)
    if new is not None:
        publish(spark, root, new)
    clean(spark, root)
    return current(spark, root)
