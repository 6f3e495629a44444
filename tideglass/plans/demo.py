"""The driver's tables as two venues' catalogs and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import gauges, taxonomy, universe
from ..params import VENUE_A, VENUE_B, Params

#: Only thirty days exist.
DEMO = Params(seed_days=5)
QUESTIONS = (
    "Will the ceasefire hold", "Who wins the election", "Government shutdown before March", "Fed rate cut in May",
    "Bitcoin above 100k", "OpenAI ships a new model", "Hottest month on record", "Who lifts the Stanley Cup", "Will it be a quiet week",
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")



def markets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Catalogs of venue A (even users) and B (odd users) from ``events``."""
    m = read(spark, sf_dir, "events").groupBy("user_id").agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") * 15).alias("total_volume_usd"), F.min("ts").alias("open_date"))
    pair = F.floor(F.col("user_id") / 2)
    title = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (pair % len(QUESTIONS) + 1).cast("int"))
    m = m.withColumn("question", F.concat(title, F.lit(" #"), pair.cast("string")))
    m = m.withColumn("close_date", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("user_id") % 10).cast("int")))
    m = m.withColumn("venue_category", F.when(F.col("user_id") % 18 == 16, "Crypto").otherwise(""))
    even = F.col("user_id") % 2 == 0
    a = m.where(even).select(F.concat(F.lit("pm_"), F.col("user_id").cast("string")).alias("market_id"), F.lit(VENUE_A).alias("venue"), "question", "venue_category", "total_volume_usd", "open_date", "close_date")
    event = F.concat(F.lit("EV-"), F.floor(F.col("user_id") / 6).cast("string"))
    b = m.where(~even).select(F.concat(F.lit("ka_"), F.col("user_id").cast("string")).alias("market_id"), F.lit(VENUE_B).alias("venue"), "question", F.lit("").alias("venue_category"), event.alias("event_ticker"), "total_volume_usd", "open_date", "close_date")
    return a, b


def prices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"), (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") * 40).alias("daily_notional_usd"))
    pinned = (F.col("user_id") % 7 == 3) & (F.col("date") >= F.lit("2024-01-20").cast("date"))
    d = d.withColumn("close_prob", F.when(pinned, 0.995).otherwise(F.col("v") / (F.col("v") + 35)))
    even = F.col("user_id") % 2 == 0
    one = lambda p: F.concat(F.lit(p), F.col("user_id").cast("string")).alias("market_id")
    return d.where(even).select(one("pm_"), "date", "close_prob"), d.where(~even).select(one("ka_"), "date", "close_prob", "daily_notional_usd")


def panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    (ma, mb), (pa, pb) = markets(spark, sf_dir), prices(spark, sf_dir)
    return taxonomy.build_panel(ma, pa, mb, pb)


def flagged(spark: SparkSession, sf_dir: str, params: Params = DEMO) -> tuple[DataFrame, DataFrame]:
    meta, rows, _ = panel(spark, sf_dir)
    return universe.apply_pit_rules(meta, rows, params)


def indices(spark: SparkSession, sf_dir: str, params: Params = DEMO) -> tuple[DataFrame, DataFrame]:
    return gauges.compute_indices(flagged(spark, sf_dir, params)[0], params)


def hundredths(x: Column) -> Column:
    """``x`` as a whole number of hundredths, rounded as a decimal of two places is. Numbers that all but are such a number, as prices are, need no decimal."""
    near = F.rint(x * 100)
    return F.when(F.abs(x * 100 - near) < 0.01, near).otherwise(F.rint(F.round(x, 2) * 100)).cast("long")


def lineitem_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long, sparse panel: suppliers as markets, shipping days as dates; all rows eligible, weight from price; a row per
    market and day, which has the quantity of the day's last line. Each line is sorted once, in its market's task; an aggregate with such an order sorts twice.
    The sort's first key is one number that tells market and day apart, so lines themselves are hardly ever compared; where numbers clash, market and day still decide."""
    day = W.partitionBy("slot", "l_suppkey", "date").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    whole = day.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").repartition("l_suppkey")
    lines = lines.withColumn("slot", F.shiftleft(F.col("l_suppkey").cast("long"), 20).bitwiseXOR(F.unix_date("date").cast("long")))
    q, price = F.last("l_quantity").over(whole), F.sum(hundredths(F.col("l_extendedprice"))).over(whole) / 100.0
    rows = lines.select("l_suppkey", "date", q.alias("q"), price.alias("price"), F.row_number().over(day).alias("nth")).where("nth = 1")
    names = F.array(*[F.lit(c) for c in ("WAR", "ELECTIONS", "POLITICS", "ECON_FED", "CRYPTO", "TECH_AI", "CLIMATE")])
    return rows.select(F.concat(F.lit("s_"), F.col("l_suppkey").cast("string")).alias("market_id"), "date", (F.col("q") / 51.0).alias("close_prob"), F.log1p("price").alias("weight"), F.element_at(names, (F.col("l_suppkey") % 7 + 1).cast("int")).alias("category"), F.lit(True).alias("eligible"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily average order price."""
    p = F.col("o_totalprice").cast("decimal(18,2)")
    return read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.sum(p).cast("double") / F.count(p)).alias("value"))


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three daily benchmarks by name: average order price, orders, and average tax of what is shipped."""
    orders = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").cast("double").alias("value"))
    tax = F.col("l_tax").cast("decimal(18,2)")
    shipped = read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg((F.sum(tax).cast("double") / F.count(tax)).alias("value"))
    named = [rows.select(F.lit(name).alias("name"), "date", "value") for name, rows in (("PRICE", benchmark(spark, sf_dir)), ("ORDERS", orders), ("TAX", shipped))]
    return named[0].union(named[1]).union(named[2])
