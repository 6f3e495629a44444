"""Landed API pages, candles, overrides and benchmark files as tables; audits and statistics as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import epoch_to_day, iso_ts_or_null, json_first_token, json_tokens, known, num_or_default, prefix_id, series_from_event, trim_text
from ..params import BACKFILL_START, VENUE_A, VENUE_B
from .shared import exists

MARKET_A = "struct<id:string,question:string,category:string,clobTokenIds:string,volumeNum:string,startDate:string,endDate:string>"
MARKET_B = "struct<ticker:string,event_ticker:string,series_ticker:string,title:string,volume_fp:string,open_time:string,close_time:string>"
PAGES_A, PAGES_B = f"markets array<{MARKET_A}>, next_cursor string", f"cursor string, markets array<{MARKET_B}>"
HISTORY_A = "market_id string, history array<struct<t:bigint,p:double>>"
CANDLES_B = "market_id string, candlesticks array<struct<end_period_ts:bigint,price:struct<close_dollars:string>,volume_fp:string>>"
MARKETS_A_SCHEMA = "market_id string, venue string, question string, venue_category string, yes_token_id string, total_volume_usd double, open_date timestamp_ntz, close_date timestamp_ntz"
MARKETS_B_SCHEMA = "market_id string, venue string, question string, venue_category string, event_ticker string, ticker string, series_ticker string, total_volume_usd double, open_date timestamp_ntz, close_date timestamp_ntz"
PRICES_A_SCHEMA, PRICES_B_SCHEMA = "market_id string, date date, close_prob double", "market_id string, date date, close_prob double, daily_notional_usd double"


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All landed pages of a folder; multi-line JSON, fixed schema, other fields are not read."""
    return spark.read.schema(schema).json(path, multiLine=True)


def landed_pages(spark: SparkSession, path: str, schema: str, market: str, key: str) -> tuple[DataFrame, DataFrame]:
    """``(pages, broken)`` of a folder of page files (and those below it), in one schema.

    A page is an object with a list of markets, or that list alone (fields of ``market``, of which ``key`` is in every one). Broken
    are files that are no JSON, that are cut off, that hold a value of another type, or are of neither form; of these ``broken``
    has ``(path, text)``, so that they can be put aside (:func:`set_aside`) and fetched again, and ``pages`` nothing. Files without
    a character are no pages.
    """
    fields = market.removeprefix("struct<").removesuffix(">").replace(":", " ")
    raw = spark.read.schema(f"{schema}, {fields.replace(',', ', ')}, broken string").json(path, multiLine=True, columnNameOfCorruptRecord="broken", recursiveFileLookup=True)
    raw = raw.withColumn("path", F.col("_metadata.file_path"))
    names = [f.split(" ")[0] for f in fields.split(",")]
    alone = F.when(F.col(key).isNotNull(), F.array(F.struct(*names)))
    good = F.col("broken").isNull() & (F.col("markets").isNotNull() | F.col(key).isNotNull())
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    bad = raw.groupBy("path").agg(F.bool_and(good).alias("good")).where("not good").select("path")
    rows = raw.join(bad, "path", "left_anti")
    return rows.select(F.coalesce("markets", alone).alias("markets")), texts.join(bad, "path").where("length(text) > 0")


def set_aside(broken: DataFrame, path: str) -> None:
    """Keep broken pages with the path they came from, beside those of earlier runs."""
    broken.write.mode("append").json(path)


def parse_pages(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """Pages that came as text in a column (a stream, a table)."""
    return raw.select(F.from_json(column, f"struct<{', '.join(x.replace(' ', ':', 1) for x in _fields(schema))}>").alias("page")).select("page.*")


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:k].strip())
            at = k + 1
    return [*out, schema[at:].strip()]


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def markets_a(pages: DataFrame) -> DataFrame:
    """Catalog of venue A; a market without tokens, or whose tokens can't be read, has no row."""
    m = pages.select(F.explode("markets").alias("m")).select("m.*").where(F.size(json_tokens(F.col("clobTokenIds"))) > 0)
    return m.select(prefix_id("pm_", F.col("id")).alias("market_id"), F.lit(VENUE_A).alias("venue"), F.coalesce("question", F.lit("")).alias("question"), trim_text(F.col("category")).alias("venue_category"), json_first_token(F.col("clobTokenIds")).alias("yes_token_id"), num_or_default(F.col("volumeNum")).alias("total_volume_usd"), iso_ts_or_null(F.col("startDate")).alias("open_date"), iso_ts_or_null(F.col("endDate")).alias("close_date"))


def markets_b(pages: DataFrame) -> DataFrame:
    """Catalog of venue B; lifetime volume counts contracts at half a dollar."""
    m = pages.select(F.explode("markets").alias("m")).select("m.*")
    return m.select(prefix_id("ka_", F.col("ticker")).alias("market_id"), F.lit(VENUE_B).alias("venue"), F.coalesce("title", F.lit("")).alias("question"), F.lit("").alias("venue_category"), "event_ticker", "ticker", series_from_event(F.col("series_ticker"), F.col("event_ticker")).alias("series_ticker"), (num_or_default(F.col("volume_fp")) * 0.5).alias("total_volume_usd"), iso_ts_or_null(F.col("open_time")).alias("open_date"), iso_ts_or_null(F.col("close_time")).alias("close_date"))


def history_a(payloads: DataFrame) -> DataFrame:
    """Last non-null price of each UTC day by place in the list; a day of nulls stays with a null.

    A long history may come in several payloads of one market; their ``page`` then goes before the place.
    """
    page = F.col("page") if "page" in payloads.columns else F.lit(0)
    x = payloads.select("market_id", page.alias("page"), F.posexplode("history").alias("pos", "h"))
    p = known(F.col("h.p"))
    return x.groupBy("market_id", epoch_to_day(F.col("h.t")).alias("date")).agg(F.max_by(p, F.when(p.isNotNull(), F.struct("page", "pos"))).alias("close_prob"))


def candles_b(payloads: DataFrame) -> DataFrame:
    """Closes and notionals; candles without a close are passed over, the last of a day counts (by ``page``, if
    payloads have one, then place)."""
    page = F.col("page") if "page" in payloads.columns else F.lit(0)
    x = payloads.select("market_id", page.alias("page"), F.posexplode("candlesticks").alias("pos", "c")).where(F.col("c.price.close_dollars").isNotNull())
    p = F.col("c.price.close_dollars").cast("double")
    rows = x.select("market_id", epoch_to_day(F.col("c.end_period_ts")).alias("date"), p.alias("close_prob"), (num_or_default(F.col("c.volume_fp")) * p).alias("daily_notional_usd"), "page", "pos")
    return keep_last(rows, ["market_id", "date"], ["page", "pos"])


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, which must tell rows of a key apart; its columns go."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", *order)


def since_backfill(markets: DataFrame, start: str = BACKFILL_START) -> DataFrame:
    return markets.where(F.col("close_date") >= F.lit(start).cast("timestamp_ntz"))


def history_todo(markets: DataFrame, done: DataFrame, floor: float, factor: float = 1.0) -> DataFrame:
    """Markets not yet stored whose volume, times ``factor``, reaches the floor (venue B: 2, an upper bound)."""
    return markets.where(known(F.col("total_volume_usd")) * factor >= floor).join(done.select("market_id").distinct(), "market_id", "left_anti")


def overrides_csv(spark: SparkSession, path: str | None) -> DataFrame:
    """Ids to drop; no path, or one at which nothing is, is no id."""
    schema = "drop_market_id string, reason string"
    return spark.read.schema(schema).csv(path, header=True) if path and exists(spark, path) else empty(spark, schema)


def bench_na(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("date date, value double").csv(path, header=True, nullValue=".")


def bench_ymd(rows: DataFrame, value: str) -> DataFrame:
    return rows.select(F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int")).alias("date"), F.col(value).cast("double").alias("value"))


def bench_lowercase(rows: DataFrame, value: str = "gprd") -> DataFrame:
    low = rows.toDF(*[c.lower() for c in rows.columns])
    return low.select(F.col("date").cast("date").alias("date"), F.col(value).cast("double").alias("value"))


def write_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_stats(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_stage(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    (rows.write.partitionBy(*by) if by else rows.write).mode("overwrite").parquet(path)


def write_bucketed(rows: DataFrame, table: str, buckets: int, key: str = "market_id", order: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` as a table of the warehouse, dealt to ``buckets`` by ``key`` and sorted in them; the table. Joins of tables with as many
    buckets by that key, and windows over it, then need no exchange, if there are at least as many as spark.sql.shuffle.partitions. An
    existing table is replaced."""
    (rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *order).format("parquet").saveAsTable(table))
    return rows.sparkSession.table(table)
