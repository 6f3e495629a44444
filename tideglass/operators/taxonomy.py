"""Two venues' catalogs and prices into one meta table and one panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import categorize

META = ["market_id", "venue", "question", "category", "event_ticker", "total_volume_usd", "open_date", "close_date"]
PANEL = ["market_id", "date", "close_prob", "daily_notional_usd"]
LEFT_OUT = ("SPORTS", "UNMAPPED")


def with_category(markets: DataFrame) -> DataFrame:
    return markets.withColumn("category", categorize(F.col("question"), F.col("venue_category")))


def union_venues(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def build_panel(meta_a: DataFrame, prices_a: DataFrame, meta_b: DataFrame, prices_b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(meta, panel, dropped)``: kept markets, their prices, and sports and unmapped markets."""
    marked = with_category(union_venues(meta_a, meta_b))
    kept = marked.where(~F.col("category").isin(*LEFT_OUT)).select(*META)
    panel = union_venues(prices_a, prices_b).select(*PANEL).join(kept.select("market_id"), "market_id", "left_semi")
    return kept, panel, marked.where(F.col("category").isin(*LEFT_OUT))


def sort_panel(panel: DataFrame) -> DataFrame:
    """Rows by market and day, for a sink: Spark deals ranges, so no task sorts them all."""
    return panel.orderBy("market_id", "date")


def normalize_counts(marked: DataFrame) -> DataFrame:
    group = F.when(F.col("category").isin(*LEFT_OUT), F.col("category")).otherwise("KEPT")
    return marked.groupBy(group.alias("grp")).agg(F.count("*").alias("n"))


def unmapped_triage(dropped: DataFrame) -> DataFrame:
    return dropped.where("category = 'UNMAPPED'").select("market_id", "venue", "question", "venue_category", "total_volume_usd")


def unmapped_volume_share(marked: DataFrame) -> DataFrame:
    v = F.col("total_volume_usd").cast("decimal(28,4)")
    return marked.agg(F.try_divide(F.sum(F.when(F.col("category") == "UNMAPPED", v)).cast("double"), F.sum(v).cast("double")).alias("share"))
