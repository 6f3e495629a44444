"""Eligibility rules, taxonomy, sources, store and streams on small tables."""

import datetime as dt
import itertools
import json
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tideglass.functions import scalars as S
from tideglass.operators import taxonomy, universe
from tideglass.params import Params
from tideglass.sources import landing, shared, store
from tideglass.streaming import prices

META = "market_id string, venue string, question string, category string, event_ticker string, total_volume_usd double, open_date timestamp_ntz, close_date timestamp_ntz"
PANEL = "market_id string, date date, close_prob double, daily_notional_usd double"
OPEN, CLOSE = dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 3, 1)
DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(59)]


def market(i, volume=200_000.0, venue="polymarket", title=None, event=None, open_=OPEN, close=CLOSE):
    return (i, venue, title or i, "WAR", event, volume, open_, close)


def run(spark, markets, rows=None, overrides=None, **params):
    meta = spark.createDataFrame(markets, META)
    rows = rows if rows is not None else [(m[0], d, 0.4, 1_000.0 if m[1] == "kalshi" else None) for m in markets for d in DAYS]
    flagged, audit = universe.apply_pit_rules(meta, spark.createDataFrame(rows, PANEL), Params(**params), overrides)
    got = {}
    for r in flagged.collect():
        got.setdefault(r.market_id, {})[r.date] = r
    return got, audit.collect()


def days_of(got, i):
    return sorted(d for d, r in got.get(i, {}).items() if r.eligible)


def test_trading_window_and_exclusion(spark):
    got, _ = run(spark, [market("pm_a"), market("pm_b", open_=None), market("pm_c", close=None)])
    assert days_of(got, "pm_a") == DAYS[1:57] and days_of(got, "pm_b") == DAYS[:57] and not days_of(got, "pm_c")


def test_floors(spark):
    got, _ = run(spark, [market("pm_small", 100.0), market("pm_at", 50_000.0), market("ka_low", 9e9, "kalshi"), market("pm_null", None)], ka_min_rolling_notional=1_000.5)
    assert not days_of(got, "pm_small") and days_of(got, "pm_at") and not days_of(got, "ka_low")
    assert days_of(got, "pm_null") and got["pm_null"][DAYS[5]].weight is None
    got, _ = run(spark, [market("ka_ok", 9e9, "kalshi")], ka_min_rolling_notional=1_000.0)
    assert days_of(got, "ka_ok") == DAYS[6:57]


def test_nan_is_missing(spark):
    rows = [("ka_n", d, 0.4, float("nan")) for d in DAYS] + [("pm_a", d, float("nan"), None) for d in DAYS]
    got, _ = run(spark, [market("ka_n", 9e9, "kalshi"), market("pm_a")], rows)
    assert not days_of(got, "ka_n") and not days_of(got, "pm_a")


def test_strikes_and_ties(spark):
    got, _ = run(spark, [market("ka_s1", 50_000.0, "kalshi", event="E"), market("ka_s2", 9_000.0, "kalshi", event="E"), market("ka_t2", 5.0, "kalshi", event="F"), market("ka_t1", 5.0, "kalshi", event="F"), market("ka_u", 1.0, "kalshi")], ka_min_rolling_notional=500.0)
    assert [bool(days_of(got, i)) for i in ("ka_s1", "ka_s2", "ka_t1", "ka_t2", "ka_u")] == [True, False, True, False, True]


def test_a_nan_volume_comes_last(spark):
    nan = float("nan")
    markets = [market("ka_n", nan, "kalshi", title="x", event="E"), market("ka_v", 900.0, "kalshi", title="y", event="E"), market("pm_t", 800.0, title="z"), market("ka_t", nan, "kalshi", title="Z")]
    meta = spark.createDataFrame(markets, META)
    assert [r.market_id for r in universe.strike_losers(meta).collect()] == ["ka_n"]
    assert [r.market_id for r in universe.strike_representatives(meta).collect()] == ["ka_v"]
    assert [(r.drop_market_id, r.keep_market_id) for r in universe.dedup_cross_venue(meta).collect()] == [("ka_t", "pm_t")]


def test_pins_have_bounds_of_their_own(spark):
    rows = [("pm_a", d, 0.97 if d >= DAYS[30] else 0.5, None) for d in DAYS]
    assert days_of(run(spark, [market("pm_a")], rows)[0], "pm_a") == DAYS[1:57]
    assert days_of(run(spark, [market("pm_a")], rows, pin_hi=0.95)[0], "pm_a") == DAYS[1:30]


def test_overrides(spark):
    drop = spark.createDataFrame([("pm_a", "same as b")], "drop_market_id string, reason string")
    got, _ = run(spark, [market("pm_a"), market("pm_b")], overrides=drop)
    assert not days_of(got, "pm_a") and days_of(got, "pm_b")


def test_terminal_pins(spark):
    p = lambda f: [f(k) for k in range(59)]
    series = {"pm_pin": p(lambda k: 0.4 if k < 30 else 0.995), "pm_round": p(lambda k: 0.995 if 20 <= k < 30 else 0.6), "pm_gap": p(lambda k: 0.4 if k < 30 else None if k == 40 else 0.005), "pm_all": p(lambda k: 0.99)}
    rows = [(i, d, v, None) for i, xs in series.items() for d, v in zip(DAYS, xs, strict=True)]
    got, _ = run(spark, [market(i) for i in series], rows)
    assert days_of(got, "pm_pin") == DAYS[1:30] == days_of(got, "pm_gap")
    assert days_of(got, "pm_round") == DAYS[1:57] and not days_of(got, "pm_all")


def test_weights_of_both_venues_are_alike(spark):
    rows = [(i, d, 0.4, 20_000.0) for i in ("pm_big", "ka_big") for d in DAYS]
    got, _ = run(spark, [market("pm_big", 1e6), market("ka_big", 1e6, "kalshi")], rows)
    assert got["pm_big"][DAYS[10]].weight / got["ka_big"][DAYS[10]].weight < 10


def test_title_dedup_needs_two_venues_and_overlap(spark):
    later = dt.datetime(2025, 1, 1)
    markets = [market("pm_x", 10.0, title="Will  IT rain"), market("ka_x", 20.0, "kalshi", "will it rain"), market("pm_y1", title="again"), market("pm_y2", title="again", open_=later, close=later), market("pm_z", 5.0, title="far"), market("ka_z", 9.0, "kalshi", "far", open_=later, close=None)]
    _, audit = run(spark, markets)
    assert [(r.drop_market_id, r.keep_market_id) for r in audit] == [("pm_x", "ka_x")]


def greedy(markets):
    """Drops by the rule as it is told, one market after the other."""
    want = []
    for _, group in itertools.groupby(sorted(markets, key=lambda m: m[2]), key=lambda m: m[2]):
        kept = []
        for m in sorted(group, key=lambda m: (-(m[5] if m[5] is not None else float("-inf")), m[0])):
            first = next((k for k in kept if k[1] != m[1] and (k[6] or dt.datetime.min) <= (m[7] or dt.datetime.max) and (m[6] or dt.datetime.min) <= (k[7] or dt.datetime.max)), None)
            want.append((m[0], first[0])) if first else kept.append(m)
    return sorted(want)


def random_markets(rng, n, titles, venues=("polymarket", "kalshi"), days=60, backward=True):
    def dates():
        a, b = (None if rng.random() < 0.1 else dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(days)) for _ in range(2))
        return (b, a) if not backward and a and b and a > b else (a, b)

    return [market(f"m{k:04d}", rng.choice([None, 1.0, 2.0, 3.0, float(k)]), rng.choice(venues), f"t{rng.randrange(titles)}", open_=x, close=y) for k, (x, y) in enumerate(dates() for _ in range(n))]


@pytest.mark.parametrize(("seed", "most"), [(0, 64), (1, 5), (2, 5)])
def test_dedup_equals_the_greedy_loop(spark, monkeypatch, seed, most):
    monkeypatch.setattr(universe, "FEW_MARKETS", most)
    rng = random.Random(seed)
    markets = random_markets(rng, 40, 4) + [market(f"z{t}{k}", rng.choice([1.0, 2.0]), rng.choice(["polymarket", "kalshi", "third"]), f"own{t}") for t in range(3) for k in range(t + 1)]
    got = universe.dedup_cross_venue(spark.createDataFrame(markets, META)).collect()
    assert sorted((r.drop_market_id, r.keep_market_id) for r in got) == greedy(markets)


def test_titles_of_many_markets_are_settled_in_rounds(spark):
    rng = random.Random(5)
    markets = random_markets(rng, 1200, 1, ("polymarket", "kalshi", "third"), 4000, backward=False)
    chain = [market(f"c{k:02d}", float(100 - k), ["polymarket", "kalshi"][k % 2], "chain", open_=dt.datetime(2024, 1, 1) + dt.timedelta(days=k), close=dt.datetime(2024, 1, 2) + dt.timedelta(days=k)) for k in range(6)]
    meta = spark.createDataFrame(markets + chain, META)
    got = universe.dedup_cross_venue(meta).collect()
    want = greedy(markets + chain)
    assert sorted((r.drop_market_id, r.keep_market_id) for r in got) == want and len(want) > 500
    rows = meta.selectExpr("question as title", "struct(-coalesce(total_volume_usd, double('-inf')) as volume, market_id) as order", "market_id", "venue", "open_date", "close_date").where("title = 'chain'")
    assert sorted((r.drop_market_id, r.keep_market_id) for r in universe.settle(rows).collect()) == greedy(chain)


def test_running_sums_go_over_partitions(spark):
    rows = spark.createDataFrame([(k % 2 if k % 3 else None, k, k * k) for k in range(500)], "g long, k long, v long").repartition(7)
    got = {r.k: r.sum_v for r in shared.running_sums(rows, ["g"], ["k"], ["v"]).collect()}
    for g in (0, 1, None):
        own = [k for k in range(500) if (k % 2 if k % 3 else None) == g]
        assert [got[k] for k in own] == list(itertools.accumulate(k * k for k in own))


def test_taxonomy(spark):
    cases = [("Lakers win NBA title", "", "SPORTS"), ("Fed rate cut", "Sports ", "SPORTS"), ("Ceasefire before the election", "", "WAR"), ("something", " Crypto", "CRYPTO"), ("something", None, "UNMAPPED"), (None, None, "UNMAPPED"), ("Coinbase listing", "", "SPORTS"), ("CPI above 3%", "", "ECON_FED")]
    rows = spark.createDataFrame([(k, q, c) for k, (q, c, _) in enumerate(cases)], "k int, q string, c string")
    got = [r.x for r in rows.select("k", S.categorize(F.col("q"), F.col("c")).alias("x")).orderBy("k").collect()]
    assert got == [x for *_, x in cases]
    whole = rows.where("k = 6").select(S.categorize(F.col("q"), F.col("c"), word_boundary=True).alias("x")).first().x
    assert whole == "CRYPTO"


def test_build_panel(spark):
    a = spark.createDataFrame([("pm_1", "polymarket", "Fed cut", "", "7", 9.0, OPEN, CLOSE), ("pm_2", "polymarket", "Lakers", "Sports", "8", 9.0, OPEN, CLOSE)], landing.MARKETS_A_SCHEMA)
    b = spark.createDataFrame([("ka_X", "kalshi", "CPI", "", "E", "X", "S", 9.0, OPEN, CLOSE)], landing.MARKETS_B_SCHEMA)
    pa = spark.createDataFrame([("pm_1", DAYS[0], 0.5), ("pm_2", DAYS[0], 0.5)], landing.PRICES_A_SCHEMA)
    pb = spark.createDataFrame([("ka_X", DAYS[0], 0.5, 3.0)], landing.PRICES_B_SCHEMA)
    meta, panel, dropped = taxonomy.build_panel(a, pa, b, pb)
    assert meta.columns == taxonomy.META and {r.market_id for r in meta.collect()} == {"pm_1", "ka_X"}
    assert {r.market_id: r.daily_notional_usd for r in panel.collect()} == {"pm_1": None, "ka_X": 3.0}
    assert [r.market_id for r in dropped.collect()] == ["pm_2"]


def test_landed_pages(spark, tmp_path):
    pages = {"markets": [{"id": "1", "question": None, "category": " US ", "clobTokenIds": '["' + "7" * 77 + '","8"]', "volumeNum": 5.5, "startDate": "2024-01-01T10:00:00.5Z", "endDate": "2024-09-10T00:00:00Z", "extra": 1}, {"id": "2", "clobTokenIds": "[]"}, {"id": "3"}, {"id": "4", "clobTokenIds": "{broken", "volumeNum": 1}, {"id": "5", "clobTokenIds": '["9"]', "endDate": "soon"}], "next_cursor": "x"}
    (tmp_path / "a").mkdir()
    (tmp_path / "a/p1.json").write_text(json.dumps(pages))
    got = {r.market_id: r for r in landing.markets_a(landing.read_pages(spark, str(tmp_path / "a"), landing.PAGES_A)).collect()}
    assert set(got) == {"pm_1", "pm_5"}
    assert got["pm_1"].yes_token_id == "7" * 77 and got["pm_1"].venue_category == "US" and got["pm_1"].open_date == dt.datetime(2024, 1, 1, 10, 0, 0, 500000)
    assert got["pm_5"].total_volume_usd == 0.0 and got["pm_5"].close_date is None
    b = {"cursor": "", "markets": [{"ticker": "T", "event_ticker": "EV-1-2", "title": "t", "volume_fp": "10.00", "open_time": "2024-01-01T00:00:00Z"}]}
    (tmp_path / "b").mkdir()
    (tmp_path / "b/p1.json").write_text(json.dumps(b))
    row = landing.markets_b(landing.read_pages(spark, str(tmp_path / "b"), landing.PAGES_B)).first()
    assert (row.market_id, row.series_ticker, row.total_volume_usd, row.close_date) == ("ka_T", "EV", 5.0, None)
    assert landing.markets_a(landing.empty(spark, landing.PAGES_A)).count() == 0


def test_broken_pages_are_put_aside_and_the_others_kept(spark, tmp_path):
    page = json.dumps({"markets": [{"id": "1", "clobTokenIds": '["7"]', "volumeNum": 5.5}], "next_cursor": "x"}, indent=1)
    files = {"good/a.json": page, "good/list.json": json.dumps([{"id": "2", "clobTokenIds": '["8"]'}, {"id": "3", "clobTokenIds": "[]"}]), "cut.json": page[: len(page) // 2], "no.json": "<html>busy</html>", "type.json": '{"markets": 5}', "other.json": '{"error": "slow down"}', "none.json": '{"markets": []}', "empty.json": ""}
    for name, text in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    good, broken = landing.landed_pages(spark, str(tmp_path / "in"), landing.PAGES_A, landing.MARKET_A, "id")
    assert {(r.market_id, r.total_volume_usd) for r in landing.markets_a(good).collect()} == {("pm_1", 5.5), ("pm_2", 0.0)}
    aside = str(tmp_path / "aside")
    landing.set_aside(broken, aside)
    landing.set_aside(broken, aside)
    got = {(r.path.rsplit("/", 1)[1], r.text) for r in spark.read.json(aside).collect()}
    assert got == {(n, t) for n, t in files.items() if n in ("cut.json", "no.json", "type.json", "other.json")}
    assert landing.overrides_csv(spark, str(tmp_path / "nowhere.csv")).count() == 0


def test_histories_and_candles(spark):
    h = spark.createDataFrame([("pm_1", [(1704067202, 0.1), (1704070000, 0.2), (1704080000, None), (1704153600, None)])], landing.HISTORY_A)
    assert {str(r.date): r.close_prob for r in landing.history_a(h).collect()} == {"2024-01-01": 0.2, "2024-01-02": None}
    c = spark.createDataFrame([("ka_1", [(1704067200, ("0.03",), "1445.67"), (1704070000, ("0.01",), None), (1704080000, (None,), "5"), (1704080001, None, "5")])], landing.CANDLES_B)
    rows = landing.candles_b(c).collect()
    assert [(r.close_prob, r.daily_notional_usd) for r in rows] == [(0.01, 0.0)]


PRICES = "market_id string, date date, close_prob double"
FEB = [dt.date(2024, 2, 1) + dt.timedelta(days=k) for k in range(5)]


def rows_of(df):
    return {(r.market_id, r.date): r.close_prob for r in df.collect()}


def test_store_last_batch_wins_and_reruns_agree(spark, tmp_path):
    root = str(tmp_path / "store")
    legacy = spark.createDataFrame([("pm_legacy", DAYS[0], 0.9), ("pm_a", DAYS[0], 0.1)], PRICES)
    assert store.finalize(spark, root) is None and store.current(spark, root) is None and store.sources(spark, root) is None
    assert store.append(spark, root, spark.createDataFrame([("pm_a", DAYS[0], 0.2), ("pm_b", DAYS[1], 0.3)], PRICES)) == 0
    store.append_batch(spark.createDataFrame([("pm_a", DAYS[0], 0.4)], PRICES), root + "/parts", 5)
    assert store.next_batch(spark, root) == 6
    assert {r.market_id for r in store.done_ids(store.sources(spark, root, legacy)).collect()} == {"pm_legacy", "pm_a", "pm_b"}
    placed = store.order_parts(store.sources(spark, root, legacy)).where("market_id = 'pm_a'")
    assert [r.batch_id for r in placed.orderBy("place").collect()] == [-1, 0, 5]
    want = {("pm_legacy", DAYS[0]): 0.9, ("pm_a", DAYS[0]): 0.4, ("pm_b", DAYS[1]): 0.3}
    final = store.finalize(spark, root, legacy)
    assert rows_of(final) == want and final.count() == 3 and store.batches(spark, root) == [] and store.next_batch(spark, root) == 6
    assert rows_of(store.finalize(spark, root, legacy)) == want and store.manifest(spark, root)["number"] == 1
    only = str(tmp_path / "only")
    assert rows_of(store.finalize(spark, only, legacy)) == {("pm_legacy", DAYS[0]): 0.9, ("pm_a", DAYS[0]): 0.1}


def test_a_stopped_finalize_changes_nothing_and_readers_keep_their_version(spark, tmp_path):
    root = str(tmp_path / "store")
    store.append(spark, root, spark.createDataFrame([("a", DAYS[0], 0.1), ("a", FEB[0], 0.2), ("n", None, 0.5)], PRICES))
    store.finalize(spark, root)
    reader = store.current(spark, root)
    store.append(spark, root, spark.createDataFrame([("a", FEB[0], 0.3), ("b", FEB[1], 0.4)], PRICES))
    lost = store.write_version(spark, root)  # stops before it publishes
    assert rows_of(store.current(spark, root)) == rows_of(reader) == {("a", DAYS[0]): 0.1, ("a", FEB[0]): 0.2, ("n", None): 0.5}
    want = {("a", DAYS[0]): 0.1, ("a", FEB[0]): 0.3, ("b", FEB[1]): 0.4, ("n", None): 0.5}
    assert rows_of(store.finalize(spark, root)) == want
    assert len(reader.collect()) == 3  # of the version before, still there
    with pytest.raises(Exception, match="(?i)exist"):
        store.publish(spark, root, lost)
    new = store.write_version(spark, root)
    assert new is None
    store.append(spark, root, spark.createDataFrame([("c", DAYS[0], 0.6)], PRICES))
    store.publish(spark, root, store.write_version(spark, root))  # stops before it deletes what is merged
    assert rows_of(store.current(spark, root)) == want | {("c", DAYS[0]): 0.6} and store.batches(spark, root) == [2]
    assert store.sources(spark, root).count() == 5
    store.append(spark, root, spark.createDataFrame([("c", DAYS[0], 0.7)], PRICES))
    assert rows_of(store.finalize(spark, root)) == want | {("c", DAYS[0]): 0.7} and store.batches(spark, root) == []
    assert len(os.listdir(root + "/manifests")) <= 4  # two, and their checksums


def files_of(root, bucket):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*.parquet") if f"bucket={bucket}" in str(p))


def test_a_micro_batch_rewrites_only_what_it_touches(spark, tmp_path):
    root = tmp_path / "store"
    first = spark.createDataFrame([("a", DAYS[0], 0.1), ("a", FEB[0], 0.2)], PRICES)
    again = spark.createDataFrame([("a", FEB[0], 0.3), ("a", FEB[0], 0.4), ("b", FEB[1], 0.5)], PRICES).coalesce(1)
    source = str(tmp_path / "in")
    january = None
    for k, rows in enumerate((first, again)):
        rows.write.mode("append").parquet(source)
        prices.upsert_prices(spark.readStream.schema(PRICES).parquet(source), str(root), str(tmp_path / "state")).awaitTermination()
        if not k:
            january = files_of(root, "2024-01")
    assert files_of(root, "2024-01") == january and len(january) == 1
    want = {("a", DAYS[0]): 0.1, ("a", FEB[0]): 0.4, ("b", FEB[1]): 0.5}
    assert rows_of(store.current(spark, str(root))) == want
    number = store.manifest(spark, str(root))["number"]
    store.upsert(spark, str(root), first, str(tmp_path / "state"), 1)  # comes again
    assert rows_of(store.current(spark, str(root))) == want and store.manifest(spark, str(root))["number"] == number == 2
    store.upsert(spark, str(root), first, "another stream", 0)
    assert rows_of(store.current(spark, str(root)))[("a", FEB[0])] == 0.2


def test_stored_buckets_need_no_exchange_by_market(spark):
    markets = [market(f"{v}{k}", 9e5 + k, {"pm": "polymarket", "ka": "kalshi"}[v], title=f"t{k % 7}", event=f"E{k % 5}") for v in ("pm", "ka") for k in range(20)]
    rows = [(m[0], d, 0.4, 9_000.0 if m[1] == "kalshi" else None) for m in markets for d in DAYS]
    plain = spark.createDataFrame(markets, META), spark.createDataFrame(rows, PANEL)
    stored = landing.write_bucketed(plain[0], "rules_meta", 8), landing.write_bucketed(plain[1], "rules_panel", 8, order=("date",))
    found = universe.apply_pit_rules(*stored)[0]
    want = universe.apply_pit_rules(*plain)[0]

    def moved(df):
        """Exchanges above a scan of the panel's close prices."""
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        depth = [min(k for k in (x.find("+- "), x.find(":- "), len(x)) if k >= 0) for x in lines]
        below = lambda k: itertools.takewhile(lambda j: depth[j] > depth[k], range(k + 1, len(lines)))
        return [lines[k] for k in range(len(lines)) if "Exchange" in lines[k] and any("Scan" in lines[j] and "close_prob" in lines[j] for j in below(k))]

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert moved(universe.apply_pit_rules(*plain)[0]) and not moved(universe.apply_pit_rules(*stored)[0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(found.collect(), key=repr) == sorted(want.collect(), key=repr)
    spark.sql("DROP TABLE rules_meta")
    spark.sql("DROP TABLE rules_panel")


def test_todo_and_bench_sources(spark, tmp_path):
    m = spark.createDataFrame([("a", 50_000.0), ("b", 49_999.0), ("c", float("nan")), ("d", 60_000.0)], "market_id string, total_volume_usd double")
    done = spark.createDataFrame([("d",)], "market_id string")
    assert [r.market_id for r in landing.history_todo(m, done, 50_000).collect()] == ["a"]
    assert {r.market_id for r in landing.history_todo(m, done, 50_000, 2).collect()} == {"a", "b"}
    (tmp_path / "v.csv").write_text("DATE,VIX\n2024-01-01,.\n2024-01-02,13.5\n")
    assert [r.value for r in landing.bench_na(spark, str(tmp_path / "v.csv")).orderBy("date").collect()] == [None, 13.5]
    ymd = spark.createDataFrame([(2024, 2, 29, 1.5)], "year int, month int, day int, v double")
    assert landing.bench_ymd(ymd, "v").first() == (dt.date(2024, 2, 29), 1.5)
    assert landing.overrides_csv(spark, None).count() == 0
    landing.write_audit(ymd, str(tmp_path / "audit"))
    assert landing.overrides_csv(spark, str(tmp_path / "audit")).count() == 1
    landing.write_stats(ymd, str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).first().v == 1.5


def test_streams_equal_tables(spark, tmp_path):
    ticks = [(f"m{k % 3}", dt.datetime(2024, 1, 1 + k % 5, k % 24, k % 60), k, k / 100) for k in range(200)]
    table = spark.createDataFrame(ticks, "market_id string, ts timestamp, seq int, price double")
    table.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = prices.daily_closes(stream, "10 days").writeStream.outputMode("complete").format("memory").queryName("closes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("closes").collect()) == sorted(prices.daily_closes(table).collect())


def test_late_ticks_are_kept_apart(spark, tmp_path):
    root, source, state = (str(tmp_path / x) for x in ("store", "in", "state"))
    schema = "market_id string, ts timestamp, seq int, price double"
    at = lambda d, h=12: dt.datetime(2024, 1, d, h)
    lots = [
        [("a", at(1), 1, 0.1), ("a", at(1), 2, 0.2), ("a", at(1, 9), 3, 0.9), ("b", at(4), 4, 0.4), (None, at(9), 5, 0.5), ("a", None, 6, 0.6)],
        [("a", at(1, 23), 7, 0.7), ("c", at(2), 8, 0.8), ("a", at(3, 20), 9, 0.3), ("a", at(6), 10, 0.5)],  # the 1st and 2nd closed at noon of the 4th less a day
        [("a", at(3, 23), 11, 0.11), ("a", at(6, 1), 12, 0.12)],
    ]
    day = 86_400_000_000
    for k, lot in enumerate(lots):
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(source)
        prices.close_days(spark.readStream.schema(schema).parquet(source), root, state, day).awaitTermination()
        if not k:
            assert {(r.market_id, r.date.day): r.close for r in prices.closed_days(spark, root, day).collect()} == {("a", 1): 0.2}
    assert sorted((r.market_id, r.seq) for r in spark.read.parquet(root + "/late").collect()) == [("a", 7), ("a", 11), ("c", 8)]
    assert {(r.market_id, r.date.day): r.close for r in store.current(spark, root).collect()} == {("a", 1): 0.2, ("b", 4): 0.4, ("a", 3): 0.3, ("a", 6): 0.5}
    assert {(r.market_id, r.date.day) for r in prices.closed_days(spark, root, day).collect()} == {("a", 1), ("b", 4), ("a", 3)}


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(k % 3 if k < 4000 else k, f"v{k}") for k in range(4500)] + [(None, "null")], "k long, v string")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    found = shared.with_fact(rows, facts, ["k"], "n")
    assert found.columns == ["k", "v", "m"]
    assert sorted(found.collect()) == sorted(rows.join(facts.drop("n"), "k").collect()) and found.count() == 4500


def in_a_scope(spark):
    with shared.scope(spark):
        return shared.durable(spark.range(2)).inputFiles()[0].removeprefix("file://")


def test_scopes_delete_their_tables(spark):
    with shared.scope(spark):
        table = shared.durable(spark.range(3))
        path = table.inputFiles()[0].removeprefix("file://")
        with ThreadPoolExecutor() as pool:  # a scope of another thread that ends before deletes only its own
            other = pool.submit(in_a_scope, spark).result()
        assert os.path.exists(path) and not os.path.exists(other)
    assert not os.path.exists(path)


def test_questions_are_normalised(spark):
    row = spark.createDataFrame([("  A  b\n\tC ",)], "q string").select(S.normalize_question(F.col("q")).alias("x")).first()
    assert row.x == "a b c"
