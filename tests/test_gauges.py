"""Gauges against naive loops: what each step means, on small panels."""

import bisect
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.operators import gauges, validate
from tideglass.params import CATEGORIES, SPORTS, UNIVERSES, Params
from tideglass.sources.shared import durable

PANEL = "market_id string, date date, close_prob double, weight double, category string, eligible boolean"
DAY = dt.date(2024, 6, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def panel(spark, rows):
    return spark.createDataFrame(rows, PANEL)


def noise(spark, jump=None, days=120, markets=8, seed=30):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(markets):
        x = 0.0
        for d in range(days):
            x += rng.normal(0, 0.05) + (2.5 if d == jump else 0)
            rows.append((f"m{m}", day(d), float(1 / (1 + math.exp(-x))), 1.0, "ECON_FED", True))
    return rows


def turbulence(spark, rows, **params):
    out, _ = gauges.compute_indices(panel(spark, rows), Params(**params))
    return {(r["date"], r["index"]): r for r in out.where("gauge = 'turbulence'").collect()}


def test_shock_day_is_the_highest(spark):
    found = turbulence(spark, noise(spark, jump=100))
    best = max((r for r in found.values() if r["index"] == "GLOBAL" and r.value is not None), key=lambda r: r.raw)
    assert best.date == day(100) and best.value > 95
    assert all(0 <= r.value <= 100 for r in found.values() if r.value is not None)


def test_ineligible_rows_change_nothing(spark):
    rows = noise(spark, days=40)
    poison = [("m0x", r[1], 0.5, 1.0, r[4], False) for r in rows if r[0] == "m0"]
    a, b = turbulence(spark, rows), turbulence(spark, rows + poison)
    assert {k: r.raw for k, r in a.items()} == {k: r.raw for k, r in b.items()}


def test_order_and_partitions_do_not_matter(spark):
    rows = noise(spark, days=60)
    other = rows[:]
    random.Random(1).shuffle(other)
    a = gauges.compute_indices(panel(spark, rows).coalesce(1), Params(seed_days=5))[0].orderBy("index", "gauge", "date").collect()
    b = gauges.compute_indices(panel(spark, other).repartition(9), Params(seed_days=5))[0].orderBy("index", "gauge", "date").collect()
    assert a == b


def test_null_weight_is_no_member(spark):
    rows = [(m, d, p, None if m == "m0" else w, c, e) for m, d, p, w, c, e in noise(spark, days=10)]
    _, members = gauges.compute_indices(panel(spark, rows))
    assert {r.n_constituents for r in members.collect()} == {7}


def test_nothing_eligible_gives_empty_tables(spark):
    out, members = gauges.compute_indices(panel(spark, noise(spark, days=3)).withColumn("eligible", F.lit(False)))
    assert out.count() == members.count() == 0 and out.columns == ["index", "date", "gauge", "raw", "value"]


def test_innovation_needs_the_spine_day_before(spark):
    rows = [("a", day(k), 0.3 + 0.05 * k, 1.0, "WAR", True) for k in (0, 1, 4, 5)] + [("b", day(k), 0.5, 1.0, "CRYPTO", True) for k in range(6)]
    got = {(r["index"], r.market_id, r.date): r.innov for r in gauges.innovations(gauges.fan_out(panel(spark, rows)), ["index"]).collect()}
    assert got["WAR", "a", day(4)] is not None and got["GLOBAL", "a", day(4)] is None
    assert got["GLOBAL", "a", day(0)] is None and got["GLOBAL", "a", day(5)] is not None


def test_ewma_counts_valid_innovations(spark):
    rng = random.Random(3)
    rows = [("a", day(k), rng.uniform(0.05, 0.95), 1.0, "WAR", True) for k in range(60) if rng.random() > 0.2]
    rows += [("b", day(k), 0.5, 1.0, "WAR", True) for k in range(60)]
    x = gauges.with_vol(gauges.fan_out(panel(spark, rows)), ["index"], F.lit(10.0))
    got = x.where("index = 'WAR' and market_id = 'a'").orderBy("date").collect()
    seen = []
    for r in got:
        if r.innov is None:
            assert r.vol is None
            continue
        seen.append(r.innov)
        w = [0.5 ** ((len(seen) - 1 - k) / 10) for k in range(len(seen))]
        want = math.sqrt(sum(a * v * v for a, v in zip(w, seen, strict=True)) / sum(w)) if len(seen) >= 5 else None
        assert r.vol == (None if want is None else pytest.approx(want, rel=1e-9))


def test_percentiles_skip_gaps_and_seed(spark):
    rng = random.Random(5)
    values = [None if rng.random() < 0.2 else round(rng.random(), 1) for _ in range(80)]
    frame = spark.createDataFrame([("i", day(k), v) for k, v in enumerate(values)], "index string, date date, raw double")
    got = [r.value for r in gauges.percentile_scale(frame, ["index"], "raw", 7).orderBy("date").collect()]
    valid = []
    for v, g in zip(values, got, strict=True):
        if v is None:
            assert g is None
            continue
        valid.append(v)
        want = 100 * sum(x <= v for x in valid[:-1]) / (len(valid) - 1) if len(valid) > 7 else None
        assert g == (None if want is None else pytest.approx(want))


def test_percentiles_of_ten_thousand_days(spark):
    """Against a sorted list that grows day by day; one series is constant, one has a single day."""
    rng = random.Random(6)
    values = [round(rng.gauss(0, 1), 2) for _ in range(10_000)]
    rows = [("i", DAY + dt.timedelta(days=k), v) for k, v in enumerate(values)] + [("flat", day(k), 1.0) for k in range(5)] + [("one", DAY, 2.0), ("none", DAY, None)]
    found = gauges.percentile_scale(spark.createDataFrame(rows, "index string, date date, raw double"), ["index"], "raw", 3).collect()
    got = {(r["index"], r.date): r.value for r in found}
    assert len(got) == len(rows)
    seen = []
    for k, v in enumerate(values):
        assert got["i", DAY + dt.timedelta(days=k)] == (pytest.approx(100 * bisect.bisect_right(seen, v) / len(seen)) if k >= 3 else None)
        bisect.insort(seen, v)
    assert [got["flat", day(k)] for k in range(5)] == [None, None, None, 100.0, 100.0] and got["one", DAY] is None and got["none", DAY] is None


@pytest.mark.parametrize("halflife", [2.0, 7.5])
def test_ewma_of_three_thousand_days_is_finite(spark, halflife):
    """1,500 half-lives and more, with a flat stretch, against the plain recursion."""
    rng = random.Random(7)
    price = [0.5 if 1000 < k < 1300 else rng.uniform(0.05, 0.95) for k in range(3000)]
    rows = [("a", DAY + dt.timedelta(days=k), p, 1.0, "WAR", True) for k, p in enumerate(price)]
    got = gauges.with_vol(gauges.fan_out(panel(spark, rows)), ["index"], F.lit(halflife)).where("index = 'WAR'").orderBy("date").collect()
    keep, top, weights = 2.0 ** (-1 / halflife), 0.0, 0.0
    assert [r.vol for r in got[:5]] == [None] * 5
    for k in range(1, 3000):
        x = math.log(price[k] / (1 - price[k])) - math.log(price[k - 1] / (1 - price[k - 1]))
        top, weights = top * keep + x * x, weights * keep + 1
        if k >= 5:
            assert got[k].vol == pytest.approx(math.sqrt(top / weights), rel=1e-9)


def test_a_market_counts_once_a_day(spark):
    """The last known price and the last known weight of a day, each by itself."""
    rows = [("a", DAY, 0.3, 1.0, "WAR", 1), ("a", DAY, 0.4, None, "WAR", 2), ("a", DAY, float("nan"), 5.0, "WAR", 3), ("b", DAY, None, None, "WAR", 1)]
    frame = spark.createDataFrame(rows, "market_id string, date date, close_prob double, weight double, category string, seq int")
    assert {r.market_id: (r.close_prob, r.weight) for r in gauges.last_per_day(frame, ["seq"]).collect()} == {"a": (0.4, 5.0), "b": (None, None)}
    twice = noise(spark, days=30)
    a = turbulence(spark, twice, seed_days=5)
    b = turbulence(spark, twice + [(m, d, p * 0.9, w, c, e) for m, d, p, w, c, e in twice], seed_days=5)
    assert {k: r.raw for k, r in a.items()} == {k: r.raw for k, r in b.items()}
    _, members = gauges.compute_indices(panel(spark, twice + twice))
    assert {r.n_constituents for r in members.collect()} == {8}


def test_a_variant_without_values_leaves_no_pair(spark):
    rows = [(v, k, day(d), None if v == "c" else float((d * (k + 2)) % 7)) for k, v in enumerate("abc") for d in range(20)]
    series = spark.createDataFrame(rows, "variant string, ord int, date date, value double")
    assert validate.robustness(series, 3).count() == 0
    assert validate.robustness(series.where("variant <> 'c'"), 3).count() == 0
    assert [(r.variant_a, r.variant_b) for r in validate.robustness(series.where("variant <> 'c'"), 2).collect()] == [("a", "b")]
    want = np.corrcoef([r[3] for r in rows if r[0] == "a"], [r[3] for r in rows if r[0] == "b"])[0, 1]
    assert validate.robustness(series, 3).count() == 0 and validate.robustness(series.where("ord < 2"), 2).first().corr == pytest.approx(want)


def test_rising_series_scales_to_hundred(spark):
    frame = spark.createDataFrame([("i", day(k), float(k)) for k in range(200)], "index string, date date, raw double")
    got = [r.value for r in gauges.percentile_scale(frame, ["index"], "raw", 90).orderBy("date").collect()]
    assert got[:90] == [None] * 90 and set(got[90:]) == {100.0}


def test_weighted_mean_masks(spark):
    frame = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (None, 9.0), (5.0, None), (7.0, 0.0)], "v double, w double")
    assert frame.agg(gauges.weighted_mean(F.col("v"), F.col("w")).alias("m")).first().m == 2.5
    assert frame.where("w is null").agg(gauges.weighted_mean(F.col("v"), F.col("w")).alias("m")).first().m is None


def tidy(spark, high):
    rows = [(day(k), "GLOBAL", "turbulence", 97.0 if k in high else 30.0) for k in range(100)]
    return spark.createDataFrame(rows, "date date, index string, gauge string, value double")


def test_events_pass_only_on_a_spike(spark):
    events = (("e", day(10).isoformat(), day(14).isoformat(), ("GLOBAL", "WAR")),)
    yes = {r["index"]: r for r in validate.check_events(tidy(spark, {14}), events).collect()}
    assert yes["GLOBAL"].passed and yes["WAR"].window_max is None and not yes["WAR"].passed
    assert not validate.check_events(tidy(spark, {15}), events).where("passed").count()


def test_top_days_are_sorted_and_ties_go_to_the_earlier(spark):
    top = [r.date for r in validate.top_spike_days(tidy(spark, {40, 20}), 3).collect()]
    assert top == [day(20), day(40), day(0)]


def test_a_lead_of_three_days_is_found(spark):
    rng = np.random.default_rng(8)
    x = np.cumsum(rng.standard_normal(300))
    rows = [(day(k), float(x[k]), float(x[k - 3] + rng.normal(0, 0.1))) for k in range(3, 300)]
    joined = spark.createDataFrame(rows, "date date, idx double, bench double")
    lags = validate.leadlag(joined)
    assert validate.best_lag(lags).first().lag == -3
    stats = {r.stat: r.corr for r in validate.corr_and_leadlag(joined).where("stat <> 'leadlag'").collect()}
    d = np.diff([r[1] for r in rows]), np.diff([r[2] for r in rows])
    assert stats["level"] == pytest.approx(np.corrcoef([r[1] for r in rows], [r[2] for r in rows])[0, 1])
    assert stats["diff"] == pytest.approx(np.corrcoef(*d)[0, 1])


def test_constant_series_has_no_correlation(spark):
    frame = spark.createDataFrame([(1.0, float(k)) for k in range(5)], "a double, b double")
    assert frame.agg(validate.pearson(F.col("a"), F.col("b")).alias("r")).first().r is None


def test_every_index_has_a_universe():
    assert set(UNIVERSES["GLOBAL"]) == set(CATEGORIES) == set(UNIVERSES) - {"GLOBAL"}
    assert not set(SPORTS) & {w for words in CATEGORIES.values() for w in words}


def test_every_index_is_compared_with_every_benchmark(spark):
    rng = np.random.default_rng(8)
    n = 60
    ours = {i: np.cumsum(rng.standard_normal(n)) for i in ("GLOBAL", "WAR")}
    bench = {b: np.cumsum(rng.standard_normal(n)) for b in ("X", "Y")}
    bench["FLAT"] = np.ones(n)
    gone = {("GLOBAL", 7), ("X", 9), ("Y", 50)}
    indices = spark.createDataFrame([(day(k), i, g, 0.0, None if (i, k) in gone else float(v[k])) for i, v in ours.items() for g in ("turbulence", "unresolvedness") for k in range(n)], "date date, index string, gauge string, raw double, value double").repartition(5)
    benchmarks = spark.createDataFrame([(b, day(k), None if (b, k) in gone else float(v[k])) for b, v in bench.items() for k in range(n)], "name string, date date, value double").repartition(3)
    got = {(r["index"], r.name, r.stat, r.lag): r.corr for r in validate.compare_benchmarks(indices, benchmarks).select("index", F.col("name").alias("name"), "stat", "lag", "corr").collect()}
    assert len(got) == 2 * 3 * 23
    for i, a in ours.items():
        for b, c in bench.items():
            keep = [k for k in range(n) if (i, k) not in gone and (b, k) not in gone]
            x, y = a[keep], c[keep]
            dx, dy = np.diff(x), np.diff(y)
            if b == "FLAT":
                assert got[i, b, "level", 0] is None and got[i, b, "leadlag", 3] is None
                continue
            assert got[i, b, "level", 0] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got[i, b, "diff", 0] == pytest.approx(np.corrcoef(dx, dy)[0, 1])
            for lag in range(-10, 11):
                u, v = (dx[lag:], dy[: len(dy) - lag]) if lag >= 0 else (dx[:lag], dy[-lag:])
                assert got[i, b, "leadlag", lag] == pytest.approx(np.corrcoef(u, v)[0, 1]), (i, b, lag)
    best = {(r["index"], r.name): r.lag for r in validate.best_lag(validate.compare_benchmarks(indices, benchmarks).where("stat = 'leadlag'"), ["index", "name"]).collect()}
    assert len(best) == 4 and all(got[i, b, "leadlag", lag] == max(got[i, b, "leadlag", k] for k in range(-10, 11)) for (i, b), lag in best.items())
    pairs = validate.leadlag_pairs(validate.align_all(indices, benchmarks), 2, ["index", "name"]).where("index = 'WAR' and name = 'X' and lag = 2").orderBy("date").collect()
    assert [p.d_bench for p in pairs[:3]] == [None, None, pytest.approx(np.diff(bench["X"][:2])[0])]


def test_nothing_aligned_gives_no_lags(spark):
    none = spark.createDataFrame([], "date date, idx double, bench double")
    assert {(r.stat, r.corr) for r in validate.corr_and_leadlag(none).collect()} == {("level", None), ("diff", None)} and validate.leadlag(none).count() == 0


def written(df):
    """Records that shuffles of ``df`` write, by the plan's own counts, once it has run."""
    df.collect()
    plan, total, left = df._jdf.queryExecution().executedPlan(), 0, []
    left.append(plan)
    while left:
        node = left.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            left.append(node.plan())
            continue
        if name == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        left += [children.apply(k) for k in range(children.size())]
    return total


def test_the_grid_shuffles_a_row_once(spark):
    rng = np.random.default_rng(4)
    days, markets = 40, 30
    rows = [(f"m{m}", day(k), float(rng.uniform(0.1, 0.9)), float(rng.uniform(3000, 7000))) for m in range(markets) for k in range(days)]
    facts = spark.createDataFrame(rows, "market_id string, date date, close_prob double, rolling double")
    facts = facts.withColumns({"venue": F.lit("kalshi"), "category": F.when(F.col("market_id") == "m0", "SPORTS").otherwise("WAR"), "total_volume_usd": F.lit(1e6), "open_date": F.lit(None).cast("timestamp_ntz"), "close_date": F.lit(str(day(days))).cast("timestamp_ntz"), "pinned": F.lit(False), "left_out": F.col("market_id") == "m1"})
    rules, sets, names = validate.parameter_sets()
    assert len(rules) == 7 and len(sets) == 10 and len(names) == 13
    got, spine = validate.variant_rows(facts, rules, sets)
    table = spark.createDataFrame([(k, r, *rules[r], h, e) for k, (r, h, e) in enumerate(sets)], "set int, rule int, exclusion int, floor_a double, floor_b double, halflife double, equal boolean")
    from tideglass.operators import universe

    crossed = facts.where("category = 'WAR'").crossJoin(table).where(universe.eligible(F.col("exclusion"), F.col("floor_a"), F.col("floor_b")))
    assert sorted((r.set, r.market_id, r.date) for r in got.collect()) == sorted((r.set, r.market_id, r.date) for r in crossed.collect())
    want = {(r.rule, r.date): r.ix for r in gauges.date_spine(crossed, ["rule"]).collect()}
    assert {(r.rule, r.date): r.ix for r in spine.collect()} == want
    spine = spark.createDataFrame(spine.collect(), spine.schema)
    masked = gauges.with_vol(got, ["set", "rule", "halflife"], F.col("halflife"), spine=spine)
    plain = gauges.with_vol(crossed, ["set", "halflife"], F.col("halflife"))
    key = lambda r: (r.set, r.market_id, r.date)
    assert {key(r): r.vol for r in masked.collect()} == {key(r): r.vol for r in plain.collect()}
    some = validate.wanted(facts, rules).count()
    assert some < days * (markets - 2) and written(masked) == some
    assert written(plain) >= crossed.count() > 5 * some


def test_many_windows_equal_a_plain_search(spark):
    rng = random.Random(2)
    values = {(i, k): rng.choice([None, rng.random()]) for i in ("GLOBAL", "WAR") for k in range(900) if rng.random() < 0.8}
    series = spark.createDataFrame([(i, day(k), v) for (i, k), v in values.items()], "index string, date date, value double")
    windows = [(n, f"e{n}", day(a := rng.randrange(-50, 950)), day(a + rng.choice([-3, 0, 1, 7, 100, 700])), rng.choice(["GLOBAL", "WAR", "NONE"])) for n in range(2000)]
    old = [(2000, "old", dt.date(1950, 1, 1), dt.date(2030, 1, 1), "WAR"), (2001, "null", None, day(4), "WAR")]
    got = {r.n: r.window_max for r in validate.window_max(series, spark.createDataFrame(windows + old, "n int, event string, start date, end date, index string")).collect()}
    number = lambda d: (d - DAY).days
    for n, _, a, b, i in windows + old[:1]:
        inside = [values[i, k] for k in range(max(0, number(a)), min(900, number(b) + 1)) if (i, k) in values]
        assert got.get(n) == max((v for v in inside if v is not None), default=None), n
        assert (n in got) == bool(inside)
    assert 2001 not in got


def test_sinks_are_sorted(spark):
    """Rows come out in order, part after part, however they went in."""
    from tideglass.operators import taxonomy

    rng = random.Random(9)
    rows = [(f"m{rng.randrange(40):02d}", day(rng.randrange(50)), float(k)) for k in range(3000)]
    found = taxonomy.sort_panel(spark.createDataFrame(rows, "market_id string, date date, v double").repartition(7))
    assert [(r.market_id, r.date) for r in found.collect()] == sorted((m, d) for m, d, _ in rows)
    tidy = [(day(rng.randrange(60)), rng.choice(list(UNIVERSES)), rng.choice(["turbulence", "unresolvedness"]), 0.0) for _ in range(3000)]
    found = gauges.sort_tidy(spark.createDataFrame(tidy, "date date, index string, gauge string, raw double").repartition(5))
    assert [(r["index"], r.gauge, r.date) for r in found.collect()] == sorted((i, g, d) for d, i, g, _ in tidy)


def plain_series(flagged):
    return gauges.index_series(gauges.fan_out(gauges.last_per_day(flagged.where("eligible")).withColumn("eligible", F.lit(True))), ["index"])


def by_index(series):
    return {(r["index"], r.date): (r.turbulence, r.unresolvedness, r.n_constituents) for r in series.collect()}


def test_a_market_is_one_series_for_all_its_indexes(spark):
    rows = noise(spark, days=40) + [(f"c{m}", d, p, w, "CRYPTO", e) for m, d, p, w, _, e in noise(spark, days=40, seed=31)]
    flagged = panel(spark, rows)
    own = gauges.by_market(durable(gauges.last_per_day(flagged)))
    assert own.where("index is null").count() == own.count() == len(rows)
    assert written(gauges.with_vol(own, ["index", "of"], F.lit(10.0))) < 1.1 * len(rows)
    assert by_index(gauges.universe_series(gauges.last_per_day(flagged))) == by_index(plain_series(flagged))


def test_markets_whose_indexes_have_other_days_are_a_series_each(spark):
    """Few markets with gaps, so spines differ; some change their category; some days have no price."""
    rng = np.random.default_rng(8)
    rows = []
    for m in range(12):
        first, last = sorted(rng.choice(60, 2, replace=False))
        for k in range(first, last + 1):
            if rng.random() < (0.4 if m % 3 else 0.95):
                cat = ("WAR", "CRYPTO", "CLIMATE", "SPORTS")[(m + (m == 5 and k > 30)) % 4]
                rows.append((f"m{m}", day(k), None if rng.random() < 0.05 else float(rng.uniform(0.02, 0.98)), float(rng.uniform(0, 15)), cat, True))
    flagged = panel(spark, rows)
    own = gauges.by_market(gauges.last_per_day(flagged))
    assert 0 < own.where("index is null").count() < own.count()
    got, want = by_index(gauges.universe_series(gauges.last_per_day(flagged))), by_index(plain_series(flagged))
    assert got == want and any(v[0] is not None for v in want.values())


def test_sums_in_whole_numbers_are_those_of_decimals(spark):
    from decimal import Decimal

    rng = np.random.default_rng(9)
    for scale in (1e-6, 1.0, 1e9):
        values = [float(v) for v in rng.uniform(-scale, scale, 500)]
        got = spark.createDataFrame([(v,) for v in values], "v double").agg(gauges.total(gauges.exact_sum(F.col("v"))).alias("s")).first().s
        assert got == pytest.approx(float(sum(map(Decimal, values))), abs=1e-9 + scale * 1e-12)


def test_the_summary_computes_the_gauges_once(spark, monkeypatch):
    from tideglass import queries as core
    from tideglass.plans import demo

    calls, real = [], demo.lineitem_flagged
    monkeypatch.setattr(demo, "lineitem_flagged", lambda s, d: calls.append(d) or real(s, d))
    monkeypatch.setattr(core, "robustness_series", lambda s, d: s.createDataFrame([], "variant string, ord int, date date, value double"))
    core.queries()["validation_summary"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def sorts_and_windows(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Sort ["), plan.count("Window [")


def test_short_series_are_one_block_without_windows_over_blocks(spark):
    rows = durable(panel(spark, noise(spark, days=60)).withColumn("index", F.lit("GLOBAL")))
    long, short = (gauges.with_vol(rows, ["index"], F.lit(0.5), short=s) for s in (False, True))
    seen = lambda x: {(r.market_id, r.date): r.vol for r in x.collect()}
    got, want = seen(short), seen(long)
    assert got.keys() == want.keys() and any(v is not None for v in want.values())
    assert all(got[k] == pytest.approx(v, rel=1e-12) if v is not None else got[k] is None for k, v in want.items())
    assert all(a < b for a, b in zip(sorts_and_windows(short), sorts_and_windows(long)))


def test_long_series_still_are_blocks(spark):
    """A half-life so short that the days are over 900 of it: 2^(days / half-life) would be no double."""
    flagged = panel(spark, noise(spark, days=40))
    got = by_index(gauges.universe_series(gauges.last_per_day(flagged), Params(ewma_halflife=0.02)))
    want = {(r["index"], r.date): (r.turbulence, r.unresolvedness, r.n_constituents) for r in gauges.index_series(gauges.fan_out(flagged), ["index"], params=Params(ewma_halflife=0.02)).collect()}
    assert got == want and any(v[0] is not None for v in want.values())


def test_rows_of_one_a_day_are_not_grouped(spark, monkeypatch):
    flagged = panel(spark, noise(spark, days=120) + [("n", day(3), float("nan"), 1.0, "WAR", True), ("n", day(4), 0.5, float("nan"), "WAR", True), ("n", day(5), 0.5, 1.0, "WAR", False)])
    rows = lambda x: sorted((r["index"], r.date, r.gauge, r.raw, r.value) for r in x.collect())
    want = [rows(gauges.compute_indices(flagged)[0].na.fill(-1.0))]
    monkeypatch.setattr(gauges, "last_per_day", None)
    assert [rows(gauges.compute_indices(flagged, one_a_day=True)[0].na.fill(-1.0))] == want


def test_lines_of_a_day_are_sorted_once(spark, tmp_path):
    """The last line by order counts, null keys before all others, with the sum of all prices."""
    from tideglass.plans import demo

    rng = np.random.default_rng(12)
    one = lambda k: None if k == 3 else int(k)
    lines = [(int(rng.integers(4)), dt.datetime(2024, 1, 1 + int(rng.integers(9))), one(rng.integers(4)), one(rng.integers(4)), one(rng.integers(4)), float(rng.integers(3)) + 0.25, float(rng.integers(1, 50))) for _ in range(600)]
    spark.createDataFrame(lines, "l_suppkey long, l_shipdate timestamp, l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    flagged = demo.lineitem_flagged(spark, str(tmp_path))
    want: dict = {}
    for s, d, *order in lines:
        least = [-1 if x is None else x for x in order]
        key, held = (f"s_{s}", d.date()), want.get((f"s_{s}", d.date()), ([-2], 0.0))
        want[key] = (max(held[0], least), held[1] + order[3])
    got = {(r.market_id, r.date): (r.close_prob, r.weight) for r in flagged.collect()}
    assert got.keys() == want.keys() and flagged.count() == len(want)
    assert all(got[k] == pytest.approx((order[-1] / 51.0, np.log1p(price))) for k, (order, price) in want.items())
    plan = demo.lineitem_flagged(spark, str(tmp_path))
    assert sorts_and_windows(plan) == (1, 1) and "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_lines_are_sorted_by_one_number_first(spark):
    from tideglass.plans import demo

    plan = demo.lineitem_flagged(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Sort [slot#" in plan and "decimal" not in plan.lower()


def test_hundredths_are_those_of_decimals(spark):
    from tideglass.plans import demo

    rng = np.random.default_rng(13)
    values = [None, 0.0, 1.005, 2.675, -1.005, 0.125, -0.125, 1e9 + 0.01, 123456789.995] + [float(v) for v in rng.uniform(-1e5, 1e5, 300)] + [round(float(v), 2) for v in rng.uniform(-1e5, 1e5, 300)] + [round(float(v), 3) for v in rng.uniform(-1e5, 1e5, 300)]
    x = F.col("v")
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(demo.hundredths(x).alias("got"), (x.cast("decimal(18,2)") * 100).cast("long").alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


@pytest.mark.parametrize("movers", [0, 2])
def test_panels_with_prices_on_all_days_sort_a_market_once(spark, monkeypatch, movers):
    """Markets of several categories alone are counted by index, in a pass of their own."""
    rng = np.random.default_rng(14)
    rows = [(f"m{m}", day(d), float(rng.uniform(0.02, 0.98)), float(rng.uniform(0, 15)), ("WAR", "CRYPTO")[(m + (m < movers and d > 20)) % 2], True) for m in range(8) for d in range(40) if m > 3 or rng.random() < 0.7]
    flagged, seen, real = panel(spark, rows), [], gauges.by_market
    want = by_index(gauges.index_series(gauges.fan_out(flagged), ["index"]))
    monkeypatch.setattr(gauges, "by_market", lambda *a: seen.append(a) or real(*a))
    daily = durable(gauges.last_per_day(flagged))
    got = by_index(gauges.universe_series(daily))
    assert got == want and any(v[0] is not None for v in want.values()) and len(seen) == (movers > 0)
    once = gauges.once_by_market(daily, gauges.spines(daily, gauges.index_universe(spark))[1], F.lit(10.0), short=True)
    assert sorts_and_windows(once)[0] == 1
