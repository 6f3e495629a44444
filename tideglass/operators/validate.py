"""Checks of the gauges: event windows, benchmarks, churn, robustness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..params import EVENTS, GRID, UNIVERSES, Params
from ..sources.shared import durable
from . import gauges, universe
from .stretches import covering, holding

PASS = 90.0


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both are known; null where one doesn't vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def event_windows(spark, events=EVENTS) -> DataFrame:
    rows = [(k, name, start, end, i) for k, (name, start, end, indexes) in enumerate(events) for i in indexes]
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, k int, event string, start string, end string, index string").select("n", "event", F.col("start").cast("date"), F.col("end").cast("date"), "index")


#: Levels of stretches of days in which window maxima are looked up: up to 256 days at once.
DAY_BITS = 8


def event_window_max(indices: DataFrame, events=EVENTS) -> DataFrame:
    """``(n, window_max)``: most turbulence in each window that has a day of its index. Windows are configuration, a few rows,
    or a table ``(n, event, start, end, index)`` of any size (:func:`window_max`)."""
    if isinstance(events, DataFrame):
        return window_max(indices.where("gauge = 'turbulence'").select("index", "date", "value"), events)
    spec = F.broadcast(event_windows(indices.sparkSession, events)).alias("e")
    days = indices.where("gauge = 'turbulence'").alias("i")
    return days.join(spec, (F.col("e.index") == F.col("i.index")) & F.col("i.date").between(F.col("e.start"), F.col("e.end"))).groupBy("n").agg(F.max("value").alias("window_max"))


def window_max(series: DataFrame, windows: DataFrame) -> DataFrame:
    """``(n, window_max)`` of windows that have a day of their index in ``series(index, date, value)``; any number of windows of any length.

    The most of each stretch of days is taken once, and a window looks up the few stretches that it is made of: a join on equal
    stretches, in place of all days against all windows.
    """
    day = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long")
    parts = series.select("index", "value", F.inline(holding(day(F.col("date")), DAY_BITS)))
    most = parts.groupBy("index", "level", "at").agg(F.max("value").alias("value"))
    wanted = windows.select("n", "index", F.inline(covering(day(F.col("start")), day(F.col("end")), DAY_BITS)))
    return wanted.join(most, ["index", "level", "at"]).groupBy("n").agg(F.max("value").alias("window_max"))


def check_events(indices: DataFrame, events=EVENTS) -> DataFrame:
    """One row per event and index, also where no day of it is known."""
    windows = events if isinstance(events, DataFrame) else event_windows(indices.sparkSession, events)
    return windows.join(event_window_max(indices, events), "n", "left").select("event", "index", "window_max", F.coalesce(F.col("window_max") >= PASS, F.lit(False)).alias("passed"))


def top_spike_days(indices: DataFrame, n: int = 10) -> DataFrame:
    return gauges.select_series(indices, "GLOBAL", "turbulence").where("value is not null").orderBy(F.desc("value"), "date").limit(n)


def align(series: DataFrame, bench: DataFrame) -> DataFrame:
    """``(date, idx, bench)`` of days on which both are known."""
    a = series.select("date", F.col("value").alias("idx")).where("idx is not null")
    return a.join(bench.select("date", F.col("value").alias("bench")).where("bench is not null"), "date")


def shifted(rows: DataFrame, value: str, n: int, by: list[str] | None = None, out: str = "shifted") -> DataFrame:
    """``rows`` with ``value`` of ``n`` rows before by date (below zero: after), within ``by``."""
    return rows.withColumn(out, F.lag(value, n).over(_days(by)))


def _days(by: list[str] | None):
    """The days of a series in order. A series has one row per day, so it is one task's; many series are many tasks'."""
    return W.partitionBy(*(by or [F.lit(0)])).orderBy("date")


def diffs(joined: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First differences over aligned days of each series, numbered."""
    w = _days(by)
    out = joined.select(*(by or []), "date", (F.col("idx") - F.lag("idx").over(w)).alias("d_idx"), (F.col("bench") - F.lag("bench").over(w)).alias("d_bench"), F.row_number().over(w).alias("rn"))
    return out.where("rn > 1")


def _lags(max_lag: int) -> dict[str, int]:
    return {f"b{k}": k - max_lag for k in range(2 * max_lag + 1)}


def with_lags(joined: DataFrame, max_lag: int = 10, by: list[str] | None = None) -> DataFrame:
    """:func:`diffs` with the benchmark change of each lag beside it, as columns ``b0`` (``-max_lag``) and on. They come from
    the window that makes the differences, so rows are neither multiplied nor joined."""
    return diffs(joined, by).select("*", *[F.lag("d_bench", lag).over(_days(by)).alias(c) for c, lag in _lags(max_lag).items()])


def _unfold(rows: DataFrame, by: list[str], max_lag: int, out: str) -> DataFrame:
    """A row per lag from a column per lag."""
    structs = [F.struct(F.lit(lag).alias("lag"), F.col(c).alias(out)) for c, lag in _lags(max_lag).items()]
    return rows.select(*by, F.inline(F.array(*structs)))


def leadlag_pairs(joined: DataFrame, max_lag: int = 10, by: list[str] | None = None) -> DataFrame:
    """``(lag, date, d_idx, d_bench)``: the index change of each day and the benchmark change ``lag`` rows before it, null where there is none."""
    return _unfold(with_lags(joined, max_lag, by), [*(by or []), "date", "d_idx"], max_lag, "d_bench").select(*(by or []), "lag", "date", "d_idx", "d_bench")


def leadlag(joined: DataFrame, max_lag: int = 10, by: list[str] | None = None) -> DataFrame:
    """``(lag, corr)``: index changes against benchmark changes ``lag`` rows before; below zero ours leads."""
    rows = with_lags(joined, max_lag, by)
    corrs = [pearson(F.col("d_idx"), F.col(c)).alias(c) for c in _lags(max_lag)]
    return _unfold(rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *corrs).where("n > 0"), by or [], max_lag, "corr")


def corr_and_leadlag(joined: DataFrame, max_lag: int = 10, by: list[str] | None = None) -> DataFrame:
    """Rows ``(stat, lag, corr)``: level, diff, and one per lag, for each of ``by``. The aligned series are written once, and both
    passes over them read that: one row per series and day."""
    by = by or []
    joined = durable(joined)
    one = lambda stat, c: F.struct(F.lit(stat).alias("stat"), F.lit(0).alias("lag"), c.alias("corr"))
    level = joined.groupBy(*by).agg(pearson(F.col("idx"), F.col("bench")).alias("corr")).select(*by, F.inline(F.array(one("level", F.col("corr")))))
    rows = with_lags(joined, max_lag, by or None)
    corrs = [pearson(F.col("d_idx"), F.col(c)).alias(c) for c in _lags(max_lag)]
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), pearson(F.col("d_idx"), F.col("d_bench")).alias("corr"), *corrs)
    diff = found.select(*by, F.inline(F.array(one("diff", F.col("corr")))))
    lags = _unfold(found.where("n > 0"), by, max_lag, "corr").select(*by, F.lit("leadlag").alias("stat"), "lag", "corr")
    return level.union(diff).union(lags)


def best_lag(lags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The lag of most correlation, the least of equal ones."""
    return lags.where("corr is not null").groupBy(*(by or [])).agg(F.max_by("lag", F.struct("corr", -F.col("lag"))).alias("lag"))


def align_all(indices: DataFrame, benchmarks: DataFrame, gauge: str = "turbulence") -> DataFrame:
    """``(index, name, date, idx, bench)``: the series of every index beside every benchmark of ``benchmarks(name, date, value)``, on days on which
    both are known."""
    ours = indices.where((F.col("gauge") == gauge) & F.col("value").isNotNull()).select("index", "date", F.col("value").alias("idx"))
    return ours.join(benchmarks.where("value is not null").select("name", "date", F.col("value").alias("bench")), "date").select("index", "name", "date", "idx", "bench")


def compare_benchmarks(indices: DataFrame, benchmarks: DataFrame, max_lag: int = 10) -> DataFrame:
    """``(index, name, stat, lag, corr)``: :func:`corr_and_leadlag` of every index with every benchmark, in one plan."""
    return corr_and_leadlag(align_all(indices, benchmarks), max_lag, ["index", "name"])


def churn_changes(indices: DataFrame, constituents: DataFrame) -> DataFrame:
    """``(date, d_value, d_n)``: changes of GLOBAL turbulence and of its members."""
    w = W.partitionBy(F.lit(0)).orderBy("date")
    a = gauges.select_series(indices, "GLOBAL", "turbulence").select("date", (F.col("value") - F.lag("value").over(w)).alias("d_value"))
    b = constituents.where("index = 'GLOBAL'").select("date", (F.col("n_constituents") - F.lag("n_constituents").over(w)).cast("double").alias("d_n"))
    return a.join(b, "date")


def churn_audit(indices: DataFrame, constituents: DataFrame) -> DataFrame:
    return churn_changes(indices, constituents).agg(pearson(F.col("d_value"), F.col("d_n")).alias("churn_corr"))


def variants(params: Params = Params(), grid=GRID) -> list[tuple[str, Params, bool]]:
    """Each parameter changed alone, and equal weights."""
    rows = [(f"{name}={v}", params.with_(**{name: v}), False) for name, values in grid.items() for v in values]
    return [*rows, ("equal_weight", params, True)]


def parameter_sets(params: Params = Params(), grid=GRID) -> tuple[list[tuple], list[tuple], list[tuple[str, int, int]]]:
    """``(rules, sets, names)`` of the grid, each of rules and sets once: thresholds of eligibility, ``(rule, halflife, equal)``, and
    ``(variant, ord, set)``. Sets that differ in half-life or weights only share a rule, names of equal parameters a set."""
    rules: dict[tuple, int] = {}
    sets: dict[tuple, int] = {}
    names = []
    for name, p, equal in variants(params, grid):
        rule = rules.setdefault((int(p.resolution_exclusion_days), float(p.pm_min_total_volume), float(p.ka_min_rolling_notional)), len(rules))
        names.append((name, len(names), sets.setdefault((rule, float(p.ewma_halflife), equal), len(sets))))
    return list(rules), list(sets), names


def wanted(facts: DataFrame, rules: list[tuple]) -> DataFrame:
    """Rows of ``facts`` that some rule wants, with ``wants``: bit k is set if rule k does."""
    bits = [F.when(universe.eligible(*[F.lit(v) for v in rule]), F.lit(1 << k)).otherwise(0) for k, rule in enumerate(rules)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return facts.where(F.col("category").isin(*UNIVERSES["GLOBAL"])).withColumn("wants", mask.cast("long")).where("wants <> 0")


def rule_spines(rows: DataFrame, n: int) -> DataFrame:
    """``(rule, date, ix)``: numbered days of each rule, from one ``bit_or`` per day over rows with a price."""
    days = rows.where("close_prob is not null").groupBy("date").agg(F.bit_or("wants").alias("wants"))
    each = days.select("date", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.getbit("wants", k) == 1)).alias("rule"))
    return each.withColumn("ix", F.row_number().over(W.partitionBy("rule").orderBy("date")))


def variant_rows(facts: DataFrame, rules: list[tuple], sets: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """``(rows, spine)``: each row once per set that wants it, with its ``weight``; and the days of each rule.

    A row travels once, with its mask, to the task of its market, and is multiplied there: all windows over a
    market's rows in a set then find them where they are.
    """
    rows = wanted(facts, rules).withColumn("weight", universe.weight(F.col("rolling"))).select("market_id", "date", "close_prob", "weight", "wants")
    table = F.array(*[F.struct(F.lit(k).alias("set"), F.lit(rule).alias("rule"), F.lit(h).alias("halflife"), F.lit(equal).alias("equal")) for k, (rule, h, equal) in enumerate(sets)])
    dealt = rows.repartition("market_id")
    own = dealt.select("market_id", "date", "close_prob", "weight", F.explode(F.filter(table, lambda s: F.getbit("wants", s["rule"]) == 1)).alias("s"))
    own = own.select("market_id", "date", "close_prob", F.when(F.col("s.equal"), 1.0).otherwise(F.col("weight")).alias("weight"), "s.set", "s.rule", "s.halflife")
    return own, rule_spines(rows, len(rules))


def variant_series(meta: DataFrame, panel: DataFrame, params: Params = Params(), grid=GRID, overrides: DataFrame | None = None) -> DataFrame:
    """``(variant, date, value)`` of GLOBAL turbulence under every variant, in one plan.

    What no parameter changes (pins, rolling means, dropped ids) is computed once and written. A row then gets a bit mask of
    the rules that want it; rows that none wants go, the others are shuffled once (:func:`variant_rows`).
    """
    rules, sets, names = parameter_sets(params, grid)
    facts = durable(universe.with_facts(meta, panel, params, overrides)[0])
    rows, spine = variant_rows(facts, rules, sets)
    series = gauges.index_series(rows, ["set", "rule", "halflife"], F.col("halflife"), params, durable(spine))
    scaled = gauges.percentile_scale(durable(series.select("set", "date", "turbulence")), ["set"], "turbulence", params.seed_days)
    return scaled.join(F.broadcast(panel.sparkSession.createDataFrame(names, "variant string, ord int, set int")), "set").select("variant", "ord", "date", "value")


def full_days(series: DataFrame, expected: int) -> DataFrame:
    """Rows of ``series(variant, ord, date, value)`` on days for which all ``expected`` variants have a value."""
    known = durable(series.where("value is not null"))
    full = known.groupBy("date").agg(F.count("*").alias("n")).where(F.col("n") == expected).select("date")
    return known.join(full, "date", "left_semi")


def variant_pairs(series: DataFrame, expected: int = len(variants())) -> DataFrame:
    """``(variant_a, variant_b, date, value_a, value_b)`` of all pairs over days that every variant has.

    ``expected`` is the number of variants in the grid: one that has no value at all leaves no day. The
    series, one row per variant and day, are written once, as the pairs read them several times.
    """
    rows = durable(full_days(series, expected))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.date") == F.col("b.date")) & (F.col("a.ord") < F.col("b.ord")))
    return pairs.select(F.col("a.variant").alias("variant_a"), F.col("b.variant").alias("variant_b"), F.col("a.date").alias("date"), F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b"))


def robustness(series: DataFrame, expected: int = len(variants())) -> DataFrame:
    """``(variant_a, variant_b, corr)`` of all pairs of :func:`variant_pairs`."""
    return variant_pairs(series, expected).groupBy("variant_a", "variant_b").agg(pearson(F.col("value_a"), F.col("value_b")).alias("corr"))


def validation_summary(indices: DataFrame, constituents: DataFrame, stats: DataFrame, pairs: DataFrame, events=EVENTS) -> DataFrame:
    """Rows ``(check, value, target, passed)``: the event windows, the days of most turbulence, level and diff correlation and best lag
    of GLOBAL with each benchmark (``stats`` of :func:`compare_benchmarks`), the worst pair of variants, churn."""
    ev = check_events(indices, events).select(F.concat(F.lit("event "), "event", F.lit(" "), "index").alias("check"), F.col("window_max").alias("value"), F.lit(PASS).alias("target"), "passed")
    none, double = F.lit(None), "double"
    worst = pairs.agg(F.min("corr").alias("value")).select(F.lit("min_pair_corr").alias("check"), "value", F.lit(0.9).alias("target"), F.coalesce(F.col("value") >= 0.9, F.lit(False)).alias("passed"))
    churn = churn_audit(indices, constituents).select(F.lit("churn_corr").alias("check"), F.col("churn_corr").alias("value"), none.cast(double).alias("target"), none.cast("boolean").alias("passed"))
    untested = [none.cast(double).alias("target"), none.cast("boolean").alias("passed")]
    spikes = top_spike_days(indices).select(F.concat(F.lit("spike "), F.col("date").cast("string")).alias("check"), "value", *untested)
    ours = stats.where("index = 'GLOBAL'")
    both = ours.where("stat <> 'leadlag'").select(F.concat("stat", F.lit("_corr "), "name").alias("check"), F.col("corr").alias("value"), *untested)
    best = best_lag(ours.where("stat = 'leadlag'"), ["name"]).select(F.concat(F.lit("best_lag "), "name").alias("check"), F.col("lag").cast(double).alias("value"), *untested)
    return ev.union(spikes).union(both).union(best).union(worst).union(churn)
