"""Point-in-time eligibility and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import known, normalize_question, windows_overlap
from ..params import VENUE_A, VENUE_B, Params
from ..sources.shared import durable, running_sums, with_fact
from .stretches import covering, holding


def rolling_notional(days: int) -> Column:
    """Mean of the market's last ``days`` rows, null unless all have a value."""
    w = W.partitionBy("market_id").orderBy("date").rowsBetween(1 - days, 0)
    return F.when(F.count("daily_notional_usd").over(w) >= days, F.avg("daily_notional_usd").over(w))


def terminal_pin(lo: float, hi: float) -> Column:
    """True on the last run of a market's prices that are all at or beyond a bound; days without a
    price are passed over. One unordered window: a row is in that run if no later price is free."""
    p = F.col("close_prob")
    last_free = F.max(F.when(p.isNotNull() & ~((p >= hi) | (p <= lo)), F.col("date"))).over(W.partitionBy("market_id"))
    return p.isNotNull() & (last_free.isNull() | (F.col("date") > last_free))


def rank_by_liquidity(meta: DataFrame, by: str) -> DataFrame:
    """``meta`` with ``place``: markets of each ``by`` from the most volume (NaN is none) down, equal ones by id."""
    w = W.partitionBy(by).orderBy(known(F.col("total_volume_usd")).desc_nulls_last(), "market_id")
    return meta.withColumn("place", F.row_number().over(w).cast("long"))


def _strikes(meta: DataFrame) -> DataFrame:
    return rank_by_liquidity(meta.where((F.col("venue") == VENUE_B) & F.col("event_ticker").isNotNull()), "event_ticker")


def strike_losers(meta: DataFrame) -> DataFrame:
    """Venue B markets that aren't their event's representative: most volume (NaN is none), then smallest id."""
    return _strikes(meta).where("place > 1").select("market_id")


def strike_representatives(meta: DataFrame) -> DataFrame:
    return _strikes(meta).where("place = 1").select("event_ticker", "market_id")


def titles_on_two_venues(meta: DataFrame) -> DataFrame:
    title = normalize_question(F.col("question")).alias("title")
    return meta.select(title, "venue").groupBy("title").agg(F.countDistinct("venue").alias("venues")).where("venues >= 2")


#: Titles with more markets are not gathered.
FEW_MARKETS = 64
REASON = "cross-venue exact title, overlapping window"


def dedup_cross_venue(meta: DataFrame) -> DataFrame:
    """``(drop_market_id, keep_market_id, reason)``: equal titles on both venues over the same period.

    Within a title markets are taken by volume, then id; one goes if a kept one of another venue
    overlaps it, and only kept ones count; it names the first such one. Titles of FEW_MARKETS markets or fewer are each decided in one
    row, those of more in rounds over all their markets at once (:func:`settle`). Both give the same.
    """
    order = F.struct((-F.coalesce(known(F.col("total_volume_usd")), F.lit(float("-inf")))).alias("volume"), "market_id")
    rows = durable(meta.select(normalize_question(F.col("question")).alias("title"), order.alias("order"), "market_id", "venue", "open_date", "close_date"))
    sizes = durable(rows.groupBy("title").agg(F.countDistinct("venue").alias("venues"), F.count("*").alias("n"), F.count("*").alias("size")).where("venues >= 2").drop("venues"))
    rows = with_fact(rows, sizes, ["title"], "n")
    found = fold_titles(rows.where(F.col("size") <= FEW_MARKETS))
    if not sizes.where(F.col("size") > FEW_MARKETS).isEmpty():
        found = found.unionByName(settle(rows.where(F.col("size") > FEW_MARKETS).drop("size")))
    return found.withColumn("reason", F.lit(REASON))


def fold_titles(rows: DataFrame) -> DataFrame:
    """Drops of ``rows(title, order, market_id, venue, open_date, close_date)``, one title at a time in a row of its own."""
    groups = rows.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("order", "market_id", "venue", "open_date", "close_date"))).alias("rows"))
    kept = "array<struct<market_id:string,venue:string,open_date:timestamp_ntz,close_date:timestamp_ntz>>"
    drops = "array<struct<drop_market_id:string,keep_market_id:string>>"
    start = F.struct(F.array().cast(kept).alias("kept"), F.array().cast(drops).alias("drops"))

    def step(acc: Column, x: Column) -> Column:
        first = F.get(F.filter(acc["kept"], lambda k: (k["venue"] != x["venue"]) & windows_overlap(k["open_date"], k["close_date"], x["open_date"], x["close_date"])), 0)
        own = F.struct(x["market_id"].alias("market_id"), x["venue"].alias("venue"), x["open_date"].alias("open_date"), x["close_date"].alias("close_date"))
        lost = F.struct(x["market_id"].alias("drop_market_id"), first["market_id"].alias("keep_market_id"))
        return F.when(first.isNull(), F.struct(F.array_append(acc["kept"], own).alias("kept"), acc["drops"].alias("drops"))).otherwise(F.struct(acc["kept"].alias("kept"), F.array_append(acc["drops"], lost).alias("drops")))

    return groups.select(F.aggregate("rows", start, step, lambda a: a["drops"]).alias("drops")).select(F.inline("drops"))


def _time_places(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``lo`` and ``hi``, the numbers of their open and close dates among all dates of their title, and how
    many bits a number has. No open date is number 0; no close date is above all others."""
    ends = [F.coalesce(c, F.lit(v).cast("timestamp_ntz")) for c, v in ((F.col("open_date"), "0001-01-01"), (F.col("close_date"), "9999-12-31"))]
    x = durable(rows.withColumn("lo", ends[0]).withColumn("hi", ends[1]))
    days = x.select("title", F.explode(F.array("lo", "hi")).alias("t")).groupBy("title", "t").agg(F.count("*").alias("n")).withColumn("one", F.lit(1).cast("long"))
    numbered = durable(running_sums(days, ["title"], ["t"], ["one"]).select("title", "t", "n", F.col("sum_one").alias("at")))
    bits = max(1, (numbered.agg(F.max("at")).first()[0] or 0).bit_length())
    for end in ("lo", "hi"):
        numbers = numbered.select("title", F.col("t").alias(end), F.col("at").alias(f"{end}_at"), "n")
        x = durable(with_fact(x, numbers, ["title", end], "n"))
    return x.drop("lo", "hi").withColumnsRenamed({"lo_at": "lo", "hi_at": "hi"}), bits


def settle(rows: DataFrame) -> DataFrame:
    """As :func:`fold_titles`, for titles of any number of markets, spread over many tasks.

    In each round a market is dropped if a kept one of another venue that comes before it overlaps it, and kept if no undecided one
    does; so the first undecided one of a title is always decided, and rounds end. There are as many as the longest chain of
    markets that each wait for the one before, mostly few. No pairs of markets are made: all a market needs is the
    first in order of those that overlap it, kept or undecided. Two lifetimes overlap if one opens within the other. (One that ends
    before it begins overlaps those that hold both its ends; such pairs alone are joined, once.) Dates
    are numbered, and numbers are halved again and again into stretches, of which a lifetime is made of two per halving at most; each
    market is listed at the stretches that hold its opening, and at those its lifetime is made of, and looks
    among the others' the other way round. A stretch keeps only its first market of each venue.
    """
    x, bits = _time_places(rows)
    holds, made = holding(F.col("lo"), bits), covering(F.col("lo"), F.col("hi"), bits)
    key = ["title", "side", "level", "at"]

    def places(df: DataFrame, listed: bool, *columns: str) -> DataFrame:
        """Opening on side 0, lifetime on side 1; those who look do so on the other side."""
        on_side = lambda k: lambda s: F.struct(F.lit(k).alias("side"), s["level"].alias("level"), s["at"].alias("at"))
        sides = [F.transform(a, on_side(k)) for k, a in enumerate((holds, made) if listed else (made, holds))]
        return df.select("title", "venue", "order", *columns, F.explode(F.concat(*sides)).alias("s")).select("title", "s.*", "venue", "order", *columns)

    def firsts(df: DataFrame) -> DataFrame:
        return places(df, True, "kept").groupBy(*key, "venue").agg(F.min(F.when(F.col("kept"), F.col("order"))).alias("kept"), F.min(F.when(~F.col("kept"), F.col("order"))).alias("open"))

    def look(df: DataFrame, among: DataFrame) -> DataFrame:
        """``df`` with the first kept and the first undecided of those of other venues ``among`` that overlap."""
        looking = durable(places(df.where("lo <= hi"), False).withColumnRenamed("venue", "own"))
        listed = firsts(among.where("lo <= hi")).groupBy(*key).agg(F.collect_list(F.struct("venue", "kept", "open")).alias("by_venue"))
        facts = durable(looking.groupBy(*key).agg(F.count("*").alias("n")).join(listed, key))
        others = F.filter("by_venue", lambda v: v["venue"] != F.col("own"))
        seen = with_fact(looking, facts, key, "n").select("order", F.array_min(F.transform(others, lambda v: v["kept"])).alias("kept"), F.array_min(F.transform(others, lambda v: v["open"])).alias("open"))
        if odd is not None:
            state = among.select(F.col("order").alias("other"), F.when(F.col("kept"), F.col("order")).alias("kept"), F.when(~F.col("kept"), F.col("order")).alias("open"))
            seen = seen.unionByName(odd.join(state, "other").select("order", "kept", "open"))
        return df.join(seen.groupBy("order").agg(F.min("kept").alias("first_kept"), F.min("open").alias("first_open")), "order", "left")

    backward, forward = x.where("lo > hi").alias("a"), x.where("lo <= hi").alias("b")
    odd = None
    if not backward.isEmpty():
        pairs = backward.join(forward, (F.col("a.title") == F.col("b.title")) & (F.col("a.venue") != F.col("b.venue")) & (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi"))).select(F.col("a.order").alias("order"), F.col("b.order").alias("other"))
        odd = durable(pairs.union(pairs.select("other", "order")).distinct())
    undecided, kept, dropped = x, None, None
    add = lambda a, b: b if a is None else a.unionByName(b)
    while not undecided.isEmpty():
        found = look(undecided, add(None if kept is None else kept.withColumn("kept", F.lit(True)), undecided.withColumn("kept", F.lit(False))))
        goes = F.coalesce(F.col("first_kept") < F.col("order"), F.lit(False))
        waits = F.coalesce(F.col("first_open") < F.col("order"), F.lit(False))
        found = durable(found.select(*x.columns, F.when(goes, "drop").when(waits, "wait").otherwise("keep").alias("what")))
        kept, dropped = add(kept, found.where("what = 'keep'").drop("what")), add(dropped, found.where("what = 'drop'").drop("what"))
        undecided = found.where("what = 'wait'").drop("what")
    return look(dropped, kept.withColumn("kept", F.lit(True))).select(F.col("market_id").alias("drop_market_id"), F.col("first_kept.market_id").alias("keep_market_id"))


def join_panel_meta(panel: DataFrame, meta: DataFrame) -> DataFrame:
    right = meta.select("market_id", "venue", "category", "event_ticker", known(F.col("total_volume_usd")).alias("total_volume_usd"), "open_date", "close_date")
    left = panel.withColumn("close_prob", known(F.col("close_prob"))).withColumn("daily_notional_usd", known(F.col("daily_notional_usd")))
    return left.join(right, "market_id", "left")


def with_facts(meta: DataFrame, panel: DataFrame, params: Params = Params(), overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Panel with what the rules ask that no threshold changes: ``pinned``, ``rolling``, ``left_out``;
    and the dedup audit. Dropped ids of all reasons are joined once."""
    audit = dedup_cross_venue(meta)
    out = strike_losers(meta).union(audit.select("drop_market_id"))
    if overrides is not None:
        out = out.union(overrides.select("drop_market_id"))
    out = out.distinct().withColumnRenamed("market_id", "out_id")
    df = join_panel_meta(panel, meta).withColumn("pinned", terminal_pin(params.pin_lo, params.pin_hi)).withColumn("rolling", rolling_notional(params.rolling_window_days))
    df = df.join(out, df["market_id"] == out["out_id"], "left").withColumn("left_out", F.col("out_id").isNotNull()).drop("out_id")
    return df, audit


def weight(rolling: Column) -> Column:
    return F.log1p(F.when(F.coalesce(F.col("venue") == VENUE_A, F.lit(False)), F.col("total_volume_usd")).otherwise(rolling))


def eligible(exclusion: Column, floor_a: Column, floor_b: Column) -> Column:
    """All rules together; what is unknown counts as the rule says."""
    yes, no = F.lit(True), F.lit(False)
    is_a, is_b = (F.coalesce(F.col("venue") == v, no) for v in (VENUE_A, VENUE_B))
    midnight = F.col("date").cast("timestamp_ntz")
    return (
        F.col("close_prob").isNotNull()
        & F.coalesce(midnight >= F.col("open_date"), yes)
        & F.coalesce(midnight < F.col("close_date") - F.make_dt_interval(exclusion.cast("int")), no)
        & ~F.col("pinned")
        & ~(is_a & F.coalesce(F.col("total_volume_usd") < floor_a, no))
        & ~(is_b & ~F.coalesce(F.col("rolling") >= floor_b, no))
        & ~F.col("left_out")
    )


def apply_pit_rules(meta: DataFrame, panel: DataFrame, params: Params = Params(), overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(flagged, audit)``: the panel with meta columns, ``weight`` and ``eligible``; dropped duplicates."""
    df, audit = with_facts(meta, panel, params, overrides)
    df = df.withColumn("weight", weight(F.col("rolling"))).withColumn("eligible", eligible(F.lit(params.resolution_exclusion_days), F.lit(params.pm_min_total_volume), F.lit(params.ka_min_rolling_notional)))
    return df.drop("pinned", "rolling", "left_out"), audit


def count_no_close(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.countDistinct(F.when(F.col("close_date").isNull(), F.col("market_id"))).alias("markets"))
