"""Daily gauges per index from the flagged panel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import binary_entropy, known, logit
from ..params import UNIVERSES, Params
from ..sources.shared import durable


def index_universe(spark, universes: dict[str, tuple[str, ...]] = UNIVERSES) -> DataFrame:
    pairs = [F.struct(F.lit(i).alias("index"), F.lit(c).alias("category")) for i, cs in universes.items() for c in cs]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def fan_out(flagged: DataFrame, universes: dict[str, tuple[str, ...]] = UNIVERSES) -> DataFrame:
    """Eligible rows, once for each index their category feeds. The universe is a few rows of configuration."""
    return flagged.where("eligible").join(F.broadcast(index_universe(flagged.sparkSession, universes)), "category")


def date_spine(rows: DataFrame, by: list[str]) -> DataFrame:
    """Days of each index on which some market has a price, numbered. Distinct first: one row per index and day."""
    days = rows.where("close_prob is not null").select(*by, "date").distinct()
    return days.withColumn("ix", F.row_number().over(W.partitionBy(*by).orderBy("date")))


def innovations(rows: DataFrame, by: list[str], params: Params = Params(), spine: DataFrame | None = None) -> DataFrame:
    """``innov``: change of the logit from the day before on the index's own spine; null after a gap. ``spine``, if it
    is known already, has columns of ``rows``, ``date`` and ``ix``, and is broadcast: it has a row per series and day. Rows that have ``ix`` need none."""
    priced = rows.where("close_prob is not null")
    if "ix" not in rows.columns:
        priced = priced.join(date_spine(rows, by), [*by, "date"]) if spine is None else priced.join(F.broadcast(spine), [c for c in spine.columns if c != "ix"])
    w = W.partitionBy("market_id", *by).orderBy("date")
    x = priced.withColumn("logit", logit(F.col("close_prob"), params))
    return x.withColumn("innov", F.when(F.col("ix") - F.lag("ix").over(w) == 1, F.col("logit") - F.lag("logit").over(w))).drop("logit")


#: Half-lives of one block of the EWMA's running sums, whose powers of two so stay finite.
BLOCK_LIVES = 100.0
#: Half-lives over which one block still is: 2^900 is a double.
ONE_BLOCK = 900.0


def with_vol(rows: DataFrame, by: list[str], halflife: Column, params: Params = Params(), spine: DataFrame | None = None, short: bool = False) -> DataFrame:
    """:func:`innovations` with ``vol``: root of the adjusted EWMA of squared innovations over valid ones.

    Weights of valid innovations are powers of two of their place from the start of a block of BLOCK_LIVES half-lives;
    a row's sum is its block's so far and those of the two blocks before, each scaled to the row (older ones
    weigh less than 2^-200). The weights' own sum is a geometric series. So no length of a series overflows.
    ``short`` says that no series has more than ONE_BLOCK half-lives of days: it is one block, without windows over blocks.
    """
    own = W.partitionBy("market_id", *by)
    before = own.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    r, nth = F.col("innov"), F.col("nth")
    size = F.greatest(F.lit(1.0), F.floor(halflife * BLOCK_LIVES))
    x = innovations(rows, by, params, spine).withColumn("nth", F.count("innov").over(before))
    x = x.withColumn("block", (F.lit(0) if short else F.floor((nth - 1) / size)).cast("int"))
    place = nth - 1 - F.col("block") * size
    x = x.withColumn("pull", F.when(r.isNotNull(), r * r * F.pow(F.lit(2.0), place / halflife)))
    if short:
        x = x.withColumn("within", F.sum("pull").over(before)).withColumn("carried", F.lit(0.0))
    else:
        x = x.withColumn("within", F.sum("pull").over(W.partitionBy("market_id", *by, "block").orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
        blocks = own.orderBy("block")  # rows are in this order already
        last = lambda k: F.coalesce(F.sum("pull").over(blocks.rangeBetween(-k, -k)), F.lit(0.0)) * F.pow(F.lit(2.0), -k * size / halflife)
        x = x.withColumn("carried", last(1) + last(2))
    x = x.withColumn("pulled", (F.col("within") + F.col("carried")) * F.pow(F.lit(2.0), -place / halflife))
    rate = -F.lit(math.log(2.0)) / halflife
    weights = F.expm1(rate * nth) / F.expm1(rate)
    x = x.withColumn("vol", F.when(r.isNotNull() & (nth >= params.ewma_min_periods), F.sqrt(F.col("pulled") / weights)))
    return x.drop("nth", "block", "pull", "within", "carried", "pulled")


def exact_sum(x: Column) -> list[Column]:
    """Sum of ``x`` to 12 places as three sums of whole numbers: of the units, the millionths, and the millionths of those. They don't depend
    on the order of rows, can be summed again, and cost less than decimals (which Spark's ``round`` of a double goes through too). :func:`total` is their value."""
    units = F.floor(x)
    fine = (x - units) * 1e6
    millionths = F.floor(fine)
    return [F.sum(units), F.sum(millionths), F.sum(F.floor((fine - millionths) * 1e6 + 0.5))]


def total(sums: list[Column]) -> Column:
    units, millionths, rest = sums
    return units + (millionths + rest / 1e6) / 1e6


def _weighted(value: Column, w: Column) -> tuple[list[Column], list[Column]]:
    """Exact sums of values by weight, and of weights, over rows with a value and a weight above zero."""
    use = value.isNotNull() & (w > 0)
    return exact_sum(F.when(use, value * w)), exact_sum(F.when(use, w))


def weighted_mean(value: Column, w: Column) -> Column:
    """Mean by weight of rows with a value and a weight above zero, in whole numbers, so that order doesn't matter."""
    above, below = _weighted(value, w)
    return F.try_divide(total(above), total(below))


_GAUGES = ("turbulence", "unresolvedness")
_parts = lambda gauge, what: [f"{gauge}_{what}_{k}" for k in range(3)]


def gauge_sums(rows: DataFrame, by: list[str], params: Params = Params()) -> DataFrame:
    """Sums of each of ``by`` and day over ``rows`` with ``vol``, from which :func:`from_sums` makes the gauges; they may be summed again."""
    w = F.col("weight")
    weighed = rows.withColumn("entropy", binary_entropy(F.col("close_prob"), params))
    sums = []
    for gauge, value in zip(_GAUGES, ("vol", "entropy")):
        above, below = _weighted(F.col(value), w)
        sums += [s.alias(n) for s, n in zip(above + below, _parts(gauge, "above") + _parts(gauge, "below"))]
    return weighed.groupBy(*by, "date").agg(*sums, F.count_if(w > 0).alias("n_constituents"))


def from_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """Raw gauges and members for each of ``by`` and day."""
    whole = lambda g, what: total([F.col(c) for c in _parts(g, what)])
    return sums.select(*by, "date", *[F.round(F.try_divide(whole(g, "above"), whole(g, "below")), 10).alias(g) for g in _GAUGES], "n_constituents")


def index_series(rows: DataFrame, by: list[str], halflife: Column | None = None, params: Params = Params(), spine: DataFrame | None = None) -> DataFrame:
    """Raw gauges and members for each of ``by`` and day."""
    x = with_vol(rows, by, F.lit(float(params.ewma_halflife)) if halflife is None else halflife, params, spine)
    return from_sums(gauge_sums(x, by, params), by)


def spines(rows: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(index, date, ix)``, the numbered days of every index; and ``(category, date, first_ix, stretch)``: the number of a category's day on
    the first index it feeds, and a number that tells category and distances to its numbers on the others. Both have a row per name and day."""
    days = durable(rows.where("close_prob is not null").select("category", "date").distinct())
    fed = days.join(F.broadcast(universe), "category")
    spine = durable(fed.select("index", "date").distinct().withColumn("ix", F.row_number().over(W.partitionBy("index").orderBy("date"))))
    places = fed.join(F.broadcast(spine), ["index", "date"]).groupBy("category", "date").agg(F.array_sort(F.collect_list(F.struct("index", "ix"))).alias("at"))
    first = F.get("at", 0)["ix"]
    apart = places.select("category", "date", first.alias("first_ix"), F.transform("at", lambda x: x["ix"] - first).alias("apart"))
    kinds = apart.select("category", "apart").distinct().withColumn("stretch", F.row_number().over(W.orderBy("category", "apart")))
    return spine, durable(apart.join(F.broadcast(kinds), ["category", "apart"]).drop("apart"))


def deal(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows with a price in their market's task, sorted there by day, with what :func:`spines` tells of their category's day. Rows travel once."""
    return rows.where("close_prob is not null").repartition("market_id").join(F.broadcast(places), ["category", "date"]).sortWithinPartitions("market_id", "date")


def by_market(rows: DataFrame, universes: dict[str, tuple[str, ...]] = UNIVERSES, known_spines: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows with a price and with ``ix``, each market's once for all indexes where their days allow, else once for each index.

    A market of one category whose numbers on all the spines it is on keep their distances over its whole life has the same gaps in each index, so the
    same ``vol``. Its rows have no ``index``, but the category as ``of``; the others have an ``index`` and no ``of``. Rows travel once, to their market's task,
    and are sorted there by day: what windows over them sort again is in order already. ``known_spines`` are those of :func:`spines`, if they are made already.
    """
    spine, places = known_spines or spines(rows, index_universe(rows.sparkSession, universes))
    own = W.partitionBy("market_id")
    dealt = deal(rows, places).withColumn("one", F.min("stretch").over(own) == F.max("stretch").over(own))
    feeds = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(i) for i in x]) for c in sorted({c for cs in universes.values() for c in cs}) for x in (c, [i for i, cs in universes.items() if c in cs])])
    each = dealt.withColumn("index", F.explode(F.when(F.col("one"), F.array(F.lit(None).cast("string"))).otherwise(F.element_at(feeds, F.col("category")))))
    placed = each.join(F.broadcast(spine), ["index", "date"], "left")
    return placed.select("index", F.when(F.col("one"), F.col("category")).alias("of"), "market_id", "date", "close_prob", "weight", F.coalesce("ix", "first_ix").alias("ix"))


def once_by_market(rows: DataFrame, places: DataFrame, halflife: Column, params: Params = Params(), short: bool = False) -> DataFrame:
    """:func:`gauge_sums` of each category (``of``) and day as if every market were one series for all indexes, apart by ``one``, which tells
    whether its market is. All windows have a market's rows by day, the order in which :func:`deal` leaves them: rows are sorted once."""
    dealt = deal(rows, places).select(F.col("category").alias("of"), "market_id", "date", "close_prob", "weight", F.col("first_ix").alias("ix"), "stretch")
    whole = W.partitionBy("market_id").orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = with_vol(dealt, [], halflife, params, short=short).withColumn("one", F.min("stretch").over(whole) == F.max("stretch").over(whole))
    return gauge_sums(x, ["of", "one"], params)


def universe_series(rows: DataFrame, params: Params = Params(), universes: dict[str, tuple[str, ...]] = UNIVERSES) -> DataFrame:
    """:func:`index_series` of every index over ``rows(market_id, date, category, close_prob, weight)``. Sums of markets that count once for all
    indexes (:func:`by_market`) are made by category, and added up for each index afterwards.

    Where every category's days keep their distances on all its indexes, as on panels with prices on all days, only markets of several categories don't
    count once. So all go once first (:func:`once_by_market`), and those markets, if there are any, by index in a second pass.
    """
    keys, halflife = ["index", "of"], F.lit(float(params.ewma_halflife))
    found = spines(rows, index_universe(rows.sparkSession, universes))
    short = (found[0].agg(F.max("ix")).first()[0] or 0) <= ONE_BLOCK * params.ewma_halflife
    several = lambda x: gauge_sums(with_vol(x, keys, halflife, params, short=short), keys, params)
    stretches, categories = found[1].agg(F.countDistinct("stretch"), F.countDistinct("category")).first()
    if stretches == categories:
        once = durable(once_by_market(rows, found[1], halflife, params, short))
        sums = once.where("one").drop("one").withColumn("index", F.lit(None).cast("string"))
        if not once.where("not one").isEmpty():
            sums = sums.unionByName(durable(several(by_market(rows, universes, found).where("index is not null"))))
    else:
        sums = durable(several(by_market(rows, universes, found)))
    fed = sums.drop("index").join(F.broadcast(index_universe(rows.sparkSession, universes)), F.col("of") == F.col("category"))
    values = [c for c in sums.columns if c not in (*keys, "date")]
    both = sums.where("of is null").select("index", "date", *values).union(fed.select("index", "date", *values))
    return from_sums(both.groupBy("index", "date").agg(*[F.sum(v).alias(v) for v in values]), ["index"])


def percentile_scale(rows: DataFrame, by: list[str], value: str, seed_days: int, out: str = "value") -> DataFrame:
    """``rows`` with ``out``: share of strictly earlier valid values that are not above, 0 to 100; the first
    ``seed_days`` valid are null. ``rows`` has one row per ``by`` and date, and no columns ``nth``, ``level``.

    Earlier values are counted in halves: valid values are numbered by day, and for each power of two a value in
    the second half of its stretch counts those of the first half that are not above. The halves of all powers
    are just the earlier values. Each stretch is sorted by value once, so a series of n days costs n log n
    rows over many tasks, and no list of days is held. ``rows`` is read twice, so it should be a table.
    """
    w = W.partitionBy(*by)
    valid = rows.where(F.col(value).isNotNull()).select(*by, "date", value, (F.row_number().over(w.orderBy("date")) - 1).alias("nth"))
    valid = valid.withColumn("level", F.ceil(F.log2(F.count("*").over(w).cast("double"))).cast("int"))
    valid = valid.withColumn("level", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("level") - 1))))
    stretch = W.partitionBy(*by, "level", F.expr("shiftright(nth, level + 1)")).orderBy(value).rangeBetween(W.unboundedPreceding, 0)
    second = F.expr("shiftright(nth, level) % 2 = 1")
    counted = valid.select(*by, "date", "nth", F.when(second, F.count(F.when(~second, 1)).over(stretch)).alias("below"))
    ranks = counted.groupBy(*by, "date", "nth").agg(F.sum("below").alias("below"))
    scaled = ranks.select(*by, "date", F.when(F.col("nth") >= max(seed_days, 1), 100.0 * F.coalesce("below", F.lit(0)) / F.col("nth")).alias(out))
    return rows.join(scaled, [*by, "date"], "left")


def tidy(series: DataFrame, by: list[str], seed_days: int) -> DataFrame:
    long = series.unpivot([*by, "date"], ["turbulence", "unresolvedness"], "gauge", "raw")
    scaled = percentile_scale(long, [*by, "gauge"], "raw", seed_days)
    return scaled.select(*by, "date", "gauge", "raw", "value")


def sort_tidy(indices: DataFrame) -> DataFrame:
    """Rows by index, gauge and day, for a sink."""
    return indices.orderBy("index", "gauge", "date")


def last_per_day(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per market, category and day: the last known price and the last known weight, each by itself.

    ``order`` names the columns that tell which is later; without them the greatest is the last, so that
    reruns agree. ``close_prob`` and ``weight`` that are NaN are unknown; a day of unknown ones has null.
    """
    def last(name: str) -> Column:
        x = known(F.col(name))
        return (F.max_by(x, F.when(x.isNotNull(), F.struct(*order))) if order else F.max(x)).alias(name)

    return rows.groupBy("market_id", "date", "category").agg(last("close_prob"), last("weight"))


def compute_indices(flagged: DataFrame, params: Params = Params(), universes: dict[str, tuple[str, ...]] = UNIVERSES, one_a_day: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(indices, constituents)``; no eligible row gives two empty tables of the same columns.

    A market that has several eligible rows on a day counts once, as :func:`last_per_day` tells; ``one_a_day`` says that
    no market has several rows on a day, so that they need not be grouped. Eligible rows
    are read for the spine and again for the gauges, and both results come from one series; so the rows and the series (one row per index and day) are written to the shared folder.
    """
    eligible = flagged.where("eligible")
    rows = durable(eligible.select("market_id", "date", "category", *[known(F.col(c)).alias(c) for c in ("close_prob", "weight")]) if one_a_day else last_per_day(eligible))
    series = durable(universe_series(rows, params, universes))
    return tidy(series, ["index"], params.seed_days), series.select("date", "index", "n_constituents")


def select_series(indices: DataFrame, index: str, gauge: str) -> DataFrame:
    return indices.where((F.col("index") == index) & (F.col("gauge") == gauge)).select("date", "value")


def index_summary(indices: DataFrame) -> DataFrame:
    rows = indices.where("gauge = 'turbulence' and value is not null")
    return rows.groupBy("index").agg(F.count("*").alias("days"), F.max_by("value", "date").alias("last_value"))


def coverage(indices: DataFrame, constituents: DataFrame) -> DataFrame:
    days = indices.where("value is not null").groupBy("index", "gauge").agg(F.count("*").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    return days.join(constituents.groupBy("index").agg(F.avg("n_constituents").alias("avg_members")), "index")
