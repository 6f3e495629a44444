"""Structured Streaming: daily closes from ticks, and upserts of daily prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import current, manifest, merge_batch, month, upsert


def daily_closes(ticks: DataFrame, late: str = "2 days") -> DataFrame:
    """Last price of each market and UTC day of ``ticks(market_id, ts, seq, price)``.

    Works on streams and tables; on a stream days close ``late`` after the newest tick and later ticks are dropped.
    """
    timed = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    grouped = timed.groupBy(F.window("ts", "1 day").alias("day"), "market_id").agg(F.max_by("price", F.struct("ts", "seq")).alias("close"))
    return grouped.select(F.to_date("day.start").alias("date"), "market_id", "close")


def upsert_prices(stream: DataFrame, root: str, checkpoint: str, bucket: Callable[[Column], Column] = month):
    """Merge each micro-batch of prices into the store at ``root``; the last to come wins.

    A micro-batch rewrites only the buckets it touches, and readers see all of it or nothing. One that is
    run again after a failure changes nothing.
    """
    return stream.writeStream.foreachBatch(lambda rows, n: upsert(rows.sparkSession, root, rows, checkpoint, n, bucket)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _day_end(date: Column) -> Column:
    return F.unix_micros(F.date_add(date, 1).cast("timestamp"))


def _last_tick(old: DataFrame | None, new: DataFrame) -> DataFrame:
    rows = new if old is None else old.unionByName(new)
    last = F.max_by(F.struct("close", "ts", "seq"), F.struct("ts", "seq")).alias("last")
    return rows.groupBy("market_id", "date").agg(last).select("market_id", "date", "last.*")


def close_days(stream: DataFrame, root: str, checkpoint: str, late_micros: int, bucket: Callable[[Column], Column] = month):
    """Last price of each market and UTC day of ``ticks(market_id, ts, seq, price)`` into the store at ``root``, and the ticks that come too late
    into ``root/late``.

    A day closes when the newest tick of earlier micro-batches is ``late_micros`` past its end. Ticks of an open day count whatever their
    order; those of a closed day change nothing any more and are kept apart, not lost. The newest tick stands in the store's
    manifest, beside the number of the micro-batch: one that comes again, or a stream that goes on after a stop,
    decides as before. Rows without time or market are passed over.
    """

    def step(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        at = manifest(spark, root)
        if n <= at["streams"].get(checkpoint, -1):
            return
        rows = rows.where("ts is not null and market_id is not null").withColumn("date", F.to_date("ts"))
        limit = at.get("newest", -(1 << 62)) - late_micros
        late = _day_end(F.col("date")) <= limit
        rows.where(late).drop("date").write.mode("overwrite").parquet(f"{root}/late/batch_id={n}")
        on_time = _last_tick(None, rows.where(~late).select("market_id", "date", F.col("price").alias("close"), "ts", "seq"))
        newest = rows.agg(F.max(F.unix_micros("ts"))).first()[0]
        merge_batch(spark, root, on_time, checkpoint, n, bucket, _last_tick, newest=max(newest if newest is not None else -(1 << 62), at.get("newest", -(1 << 62))))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_days(spark: SparkSession, root: str, late_micros: int) -> DataFrame | None:
    """``(market_id, date, close)`` of the days that are closed: what no later tick changes."""
    rows, at = current(spark, root), manifest(spark, root)
    return None if rows is None else rows.where(_day_end(F.col("date")) <= at["newest"] - late_micros).select("market_id", "date", "close")
