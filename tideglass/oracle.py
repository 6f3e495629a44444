"""SQL for the same rows as the queries, for an engine that reads the same tables."""

from __future__ import annotations

from .params import CATEGORIES, EVENTS, SPORTS, SPORTS_VENUE, UNIVERSES, VENUE_CATEGORIES
from .plans.demo import QUESTIONS


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce(question, '')), '{w}')" for w in words) + ")"


def categorize(question: str = "question", category: str = "venue_category") -> str:
    vc = f"lower(trim(coalesce({category}, '')))"
    cases = [f"WHEN {vc} IN ({', '.join(repr(x) for x in SPORTS_VENUE)}) OR {_any(SPORTS)} THEN 'SPORTS'"]
    cases += [f"WHEN {_any(words)} THEN '{name}'" for name, words in CATEGORIES.items()]
    cases += [f"WHEN {vc} = '{x}' THEN '{name}'" for x, name in VENUE_CATEGORIES.items()]
    return f"CASE {' '.join(cases)} ELSE 'UNMAPPED' END".replace("question", question)


_TITLE = "CASE (user_id // 2) % {} {} END".format(len(QUESTIONS), " ".join(f"WHEN {k} THEN '{q}'" for k, q in enumerate(QUESTIONS)))
_INDEX = "(VALUES " + ", ".join(f"('{i}', '{c}')" for i, cs in UNIVERSES.items() for c in cs) + ") AS u(\"index\", category)"

MARKETS = f"""
users AS (
  SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) * 15 AS total_volume_usd, min(ts) AS open_date FROM events GROUP BY user_id
), raw_meta AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'pm_' ELSE 'ka_' END || user_id AS market_id,
    CASE WHEN user_id % 2 = 0 THEN 'polymarket' ELSE 'kalshi' END AS venue,
    {_TITLE} || ' #' || (user_id // 2) AS question,
    CASE WHEN user_id % 18 = 16 THEN 'Crypto' ELSE '' END AS venue_category,
    CASE WHEN user_id % 2 = 1 THEN 'EV-' || (user_id // 6) END AS event_ticker, total_volume_usd, open_date,
    TIMESTAMP '2024-01-30 00:00:00' + to_days(CAST(user_id % 10 AS INTEGER)) AS close_date
  FROM users
), marked AS (SELECT *, {categorize()} AS category FROM raw_meta
), meta AS (SELECT market_id, venue, question, category, event_ticker, total_volume_usd, open_date, close_date FROM marked WHERE category NOT IN ('SPORTS', 'UNMAPPED')
)"""
PANEL = (
    MARKETS
    + """, ranked AS (
  SELECT user_id, CAST(ts AS DATE) AS date, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS k FROM events
), days AS (
  SELECT user_id, date, max(value) FILTER (k = 1) AS v, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) * 40 AS notional FROM ranked GROUP BY user_id, date
), panel AS (
  SELECT * FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'pm_' ELSE 'ka_' END || user_id AS market_id, date,
    CASE WHEN user_id % 7 = 3 AND date >= DATE '2024-01-20' THEN 0.995 ELSE v / (v + 35) END AS close_prob,
    CASE WHEN user_id % 2 = 1 THEN notional END AS daily_notional_usd FROM days)
  WHERE market_id IN (SELECT market_id FROM meta)
)"""
)
FLAGGED = (
    PANEL
    + """, reps AS (
  SELECT market_id, event_ticker, row_number() OVER (PARTITION BY event_ticker ORDER BY total_volume_usd DESC NULLS LAST, market_id) AS k FROM meta WHERE venue = 'kalshi' AND event_ticker IS NOT NULL
), titled AS (SELECT *, trim(regexp_replace(lower(coalesce(question, '')), '\\s+', ' ', 'g')) AS title FROM meta
), audit AS (
  SELECT b.market_id AS drop_market_id, a.market_id AS keep_market_id, 'cross-venue exact title, overlapping window' AS reason
  FROM titled a JOIN titled b ON a.title = b.title AND a.venue <> b.venue AND a.open_date <= b.close_date AND b.open_date <= a.close_date
    AND (a.total_volume_usd > b.total_volume_usd OR (a.total_volume_usd = b.total_volume_usd AND a.market_id < b.market_id))
), facts AS (
  SELECT p.*, m.venue, m.category, m.event_ticker, m.total_volume_usd, m.open_date, m.close_date,
    max(CASE WHEN close_prob < 0.99 AND close_prob > 0.01 THEN date END) OVER (PARTITION BY market_id) AS last_free,
    CASE WHEN count(daily_notional_usd) OVER w >= 7 THEN avg(daily_notional_usd) OVER w END AS rolling
  FROM panel p LEFT JOIN meta m USING (market_id) WINDOW w AS (PARTITION BY market_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
), judged AS (
  SELECT *, ln(1 + CASE WHEN venue = 'polymarket' THEN total_volume_usd ELSE rolling END) AS weight,
    close_prob IS NOT NULL AS price_present, coalesce(CAST(date AS TIMESTAMP) >= open_date, true) AS open_window,
    coalesce(CAST(date AS TIMESTAMP) < close_date - INTERVAL 3 DAY, false) AS before_close,
    close_prob IS NOT NULL AND (last_free IS NULL OR date > last_free) AS pinned,
    coalesce(venue = 'polymarket' AND total_volume_usd < 50000, false) AS below_a,
    coalesce(venue = 'kalshi', false) AND NOT coalesce(rolling >= 5000, false) AS below_b,
    market_id IN (SELECT market_id FROM reps WHERE k > 1) AS strike_loser, market_id IN (SELECT drop_market_id FROM audit) AS duplicate
  FROM facts
), flagged AS (
  SELECT market_id, date, close_prob, daily_notional_usd, venue, category, event_ticker, total_volume_usd, open_date, close_date, weight,
    price_present AND open_window AND before_close AND NOT pinned AND NOT below_a AND NOT below_b AND NOT strike_loser AND NOT duplicate AS eligible
  FROM judged
)"""
)


def series(source: str, seed: int) -> str:
    """CTEs from ``source`` (market_id, date, close_prob, weight, category, eligible) to ``indices`` and ``constituents``."""
    return f""", fanned AS (SELECT f.*, u."index" FROM {source} f JOIN {_INDEX} ON f.category = u.category WHERE eligible
), spine AS (SELECT "index", date, row_number() OVER (PARTITION BY "index" ORDER BY date) AS ix FROM (SELECT DISTINCT "index", date FROM fanned WHERE close_prob IS NOT NULL)
), logits AS (
  SELECT f."index", f.market_id, f.date, f.weight, f.close_prob, s.ix, greatest(0.01, least(0.99, f.close_prob)) AS c FROM fanned f JOIN spine s ON f."index" = s."index" AND f.date = s.date WHERE f.close_prob IS NOT NULL
), innovations AS (
  SELECT *, CASE WHEN ix - lag(ix) OVER w = 1 THEN ln(c / (1 - c)) - lag(ln(c / (1 - c))) OVER w END AS innov FROM logits WINDOW w AS (PARTITION BY "index", market_id ORDER BY date)
), counted AS (SELECT *, count(innov) OVER (PARTITION BY "index", market_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS k FROM innovations
), vols AS (
  SELECT *, CASE WHEN innov IS NOT NULL AND k >= 5 THEN sqrt(sum(innov * innov * pow(2, k / 10.0)) OVER w / sum(CASE WHEN innov IS NOT NULL THEN pow(2, k / 10.0) END) OVER w) END AS vol,
    -(c * log2(c) + (1 - c) * log2(1 - c)) AS entropy
  FROM counted WINDOW w AS (PARTITION BY "index", market_id ORDER BY date ROWS UNBOUNDED PRECEDING)
), raws AS (
  SELECT "index", date,
    round(CAST(sum(CAST(vol * weight AS DECIMAL(28,12))) FILTER (vol IS NOT NULL AND weight > 0) AS DOUBLE) / CAST(sum(CAST(weight AS DECIMAL(28,12))) FILTER (vol IS NOT NULL AND weight > 0) AS DOUBLE), 10) AS turbulence,
    round(CAST(sum(CAST(entropy * weight AS DECIMAL(28,12))) FILTER (weight > 0) AS DOUBLE) / CAST(sum(CAST(weight AS DECIMAL(28,12))) FILTER (weight > 0) AS DOUBLE), 10) AS unresolvedness,
    count(*) FILTER (weight > 0) AS n_constituents
  FROM vols GROUP BY "index", date
), constituents AS (SELECT date, "index", n_constituents FROM raws
), long AS (
  SELECT "index", date, 'turbulence' AS gauge, turbulence AS raw FROM raws UNION ALL SELECT "index", date, 'unresolvedness', unresolvedness FROM raws
), numbered AS (SELECT *, CASE WHEN raw IS NOT NULL THEN row_number() OVER (PARTITION BY "index", gauge, raw IS NULL ORDER BY date) END AS n FROM long
), indices AS (
  SELECT a."index", a.date, a.gauge, a.raw, CASE WHEN a.n > {max(seed, 1)} THEN 100.0 * (SELECT count(*) FROM numbered b WHERE b."index" = a."index" AND b.gauge = a.gauge AND b.n < a.n AND b.raw <= a.raw) / (a.n - 1) END AS value FROM numbered a
)"""


def _variants() -> str:
    """CTEs from the judged panel to the pair correlations of all variants of the parameter grid."""
    from .operators.validate import variants

    rows = ", ".join(f"('{name}', {k}, {float(p.ewma_halflife)}, {int(p.resolution_exclusion_days)}, {float(p.pm_min_total_volume)}, {float(p.ka_min_rolling_notional)}, {str(equal).lower()})" for k, (name, p, equal) in enumerate(variants()))
    names = ", ".join(f"'{c}'" for c in UNIVERSES["GLOBAL"])
    return f""", grid AS (
  SELECT variant, CAST(ord AS INTEGER) AS ord, CAST(halflife AS DOUBLE) AS halflife, exclusion, floor_a, floor_b, equal FROM (VALUES {rows}) AS g(variant, ord, halflife, exclusion, floor_a, floor_b, equal)
), v_rows AS (
  SELECT g.ord, g.halflife, j.market_id, j.date, CASE WHEN g.equal THEN 1.0 ELSE j.weight END AS weight, greatest(0.01, least(0.99, j.close_prob)) AS c FROM judged j CROSS JOIN grid g
  WHERE price_present AND open_window AND coalesce(CAST(date AS TIMESTAMP) < close_date - to_days(CAST(g.exclusion AS INTEGER)), false) AND NOT pinned
    AND NOT coalesce(venue = 'polymarket' AND total_volume_usd < g.floor_a, false) AND NOT (coalesce(venue = 'kalshi', false) AND NOT coalesce(rolling >= g.floor_b, false))
    AND NOT strike_loser AND NOT duplicate AND category IN ({names})
), v_spine AS (SELECT ord, date, row_number() OVER (PARTITION BY ord ORDER BY date) AS ix FROM (SELECT DISTINCT ord, date FROM v_rows)
), v_innov AS (
  SELECT r.*, CASE WHEN ix - lag(ix) OVER w = 1 THEN ln(c / (1 - c)) - lag(ln(c / (1 - c))) OVER w END AS innov FROM v_rows r JOIN v_spine s ON r.ord = s.ord AND r.date = s.date WINDOW w AS (PARTITION BY r.ord, market_id ORDER BY r.date)
), v_counted AS (SELECT *, count(innov) OVER (PARTITION BY ord, market_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS k FROM v_innov
), v_vols AS (
  SELECT *, CASE WHEN innov IS NOT NULL AND k >= 5 THEN sqrt(sum(innov * innov * pow(2, k / halflife)) OVER w / sum(CASE WHEN innov IS NOT NULL THEN pow(2, k / halflife) END) OVER w) END AS vol
  FROM v_counted WINDOW w AS (PARTITION BY ord, market_id ORDER BY date ROWS UNBOUNDED PRECEDING)
), v_raws AS (
  SELECT ord, date, round(CAST(sum(CAST(vol * weight AS DECIMAL(28,12))) FILTER (vol IS NOT NULL AND weight > 0) AS DOUBLE) / CAST(sum(CAST(weight AS DECIMAL(28,12))) FILTER (vol IS NOT NULL AND weight > 0) AS DOUBLE), 10) AS raw FROM v_vols GROUP BY ord, date
), v_numbered AS (SELECT *, CASE WHEN raw IS NOT NULL THEN row_number() OVER (PARTITION BY ord, raw IS NULL ORDER BY date) END AS n FROM v_raws
), variant_series AS (
  SELECT g.variant, g.ord, a.date, CASE WHEN a.n > 5 THEN 100.0 * (SELECT count(*) FROM v_numbered b WHERE b.ord = a.ord AND b.n < a.n AND b.raw <= a.raw) / (a.n - 1) END AS value FROM v_numbered a JOIN grid g ON g.ord = a.ord
), full_series AS (
  SELECT * FROM variant_series WHERE value IS NOT NULL AND date IN (SELECT date FROM variant_series GROUP BY date HAVING count(value) = (SELECT count(*) FROM grid))
), pairs AS (
  SELECT a.variant AS variant_a, b.variant AS variant_b, a.date, a.value AS value_a, b.value AS value_b FROM full_series a JOIN full_series b ON a.date = b.date AND a.ord < b.ord
), pair_corrs AS (SELECT variant_a, variant_b, {corr("value_a", "value_b")} AS corr FROM pairs GROUP BY variant_a, variant_b)"""


INDICES = FLAGGED + series("flagged", 5)
LINEITEM = (
    """
li AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_quantity DESC) AS k FROM lineitem
), supplied AS (
  SELECT 's_' || l_suppkey AS market_id, CAST(l_shipdate AS DATE) AS date, max(l_quantity) FILTER (k = 1) / 51.0 AS close_prob,
    ln(1 + CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)) AS weight,
    CASE l_suppkey % 7 """
    + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CATEGORIES))
    + """ END AS category, true AS eligible
  FROM li GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
)"""
    + series("supplied", 90)
)
BENCH = ", bench AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS value FROM orders GROUP BY 1), ours AS (SELECT date, value FROM indices WHERE \"index\" = 'GLOBAL' AND gauge = 'turbulence'), joined AS (SELECT o.date, o.value AS idx, b.value AS bench FROM ours o JOIN bench b ON o.date = b.date WHERE o.value IS NOT NULL AND b.value IS NOT NULL), d AS (SELECT * FROM (SELECT date, idx - lag(idx) OVER (ORDER BY date) AS d_idx, bench - lag(bench) OVER (ORDER BY date) AS d_bench, row_number() OVER (ORDER BY date) AS rn FROM joined) WHERE rn > 1)"
#: CTEs after LINEITEM: three benchmarks, each index beside each of them, differences, lags.
NAMED = """, named AS (
  SELECT 'PRICE' AS name, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS value FROM orders GROUP BY 2
  UNION ALL SELECT 'ORDERS', CAST(o_orderdate AS DATE), CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2
  UNION ALL SELECT 'TAX', CAST(l_shipdate AS DATE), CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(l_tax) FROM lineitem GROUP BY 2
), beside AS (
  SELECT i."index", n.name, i.date, i.value AS idx, n.value AS bench FROM indices i JOIN named n ON i.date = n.date WHERE i.gauge = 'turbulence' AND i.value IS NOT NULL AND n.value IS NOT NULL
), changes AS (
  SELECT * FROM (SELECT "index", name, date, idx - lag(idx) OVER w AS d_idx, bench - lag(bench) OVER w AS d_bench, row_number() OVER w AS rn FROM beside WINDOW w AS (PARTITION BY "index", name ORDER BY date)) WHERE rn > 1
), moved AS (
  SELECT a."index", a.name, l.lag, a.date, a.d_idx, b.d_bench FROM changes a CROSS JOIN (SELECT CAST(unnest(range(-10, 11)) AS INTEGER) AS lag) l
  LEFT JOIN changes b ON b."index" = a."index" AND b.name = a.name AND b.rn = a.rn - l.lag
)"""
EVENT_ROWS = "(VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}', '{i}')" for n, a, b, xs in EVENTS for i in xs) + ") AS e(event, \"start\", \"end\", \"index\")"


def corr(a: str, b: str) -> str:
    return f"round(CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END, 6)"


def both(a: str, b: str) -> str:
    """Correlation over rows that have both."""
    return corr(f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END")


NAMED += f""", named_stats AS (
  SELECT "index", name, 'level' AS stat, CAST(0 AS INTEGER) AS lag, {corr("idx", "bench")} AS corr FROM beside GROUP BY ALL
  UNION ALL SELECT "index", name, 'diff', CAST(0 AS INTEGER), {corr("d_idx", "d_bench")} FROM changes GROUP BY "index", name
  UNION ALL SELECT "index", name, 'leadlag', lag, {both("d_idx", "d_bench")} FROM moved GROUP BY "index", name, lag
)"""
VARIANTS = FLAGGED + _variants()


def over(base: str, select: str) -> str:
    return f"WITH {base} {select}"
