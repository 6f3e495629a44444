"""Scalar functions of the gauges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import CATEGORIES, SPORTS, SPORTS_VENUE, VENUE_CATEGORIES, Params


def known(x: Column) -> Column:
    """NaN is null: Spark orders NaN above all numbers."""
    return F.when(~F.isnan(x), x)


def clip_prob(p: Column, params: Params = Params()) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.lit(params.clip_lo), F.least(F.lit(params.clip_hi), p)))


def logit(p: Column, params: Params = Params()) -> Column:
    c = clip_prob(p, params)
    return F.log(c / (1.0 - c))


def binary_entropy(p: Column, params: Params = Params()) -> Column:
    c = clip_prob(p, params)
    return -(c * F.log2(c) + (1.0 - c) * F.log2(1.0 - c))


def normalize_question(q: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(q, F.lit(""))), r"(?U)\s+", " "))


def venue_category(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def map_venue_category(c: Column) -> Column:
    """The category a venue's own one stands for, else UNMAPPED."""
    table = F.create_map(*[F.lit(x) for pair in VENUE_CATEGORIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, venue_category(c)), F.lit("UNMAPPED"))


def categorize(question: Column, category: Column, word_boundary: bool = False) -> Column:
    """Sports, else the first category with a keyword in the title, else the venue's. Keywords are
    substrings; ``word_boundary`` asks for whole words instead.

    The title is lowered once, as the only element of an array, and each category's keywords are an array that is gone through to the
    first hit: no alternation of words is compiled, and generated code doesn't grow with them.
    """

    def has(text: Column, words: tuple[str, ...]) -> Column:
        if word_boundary:
            return text.rlike(r"\b(?:" + "|".join(w.strip() for w in words) + r")\b")
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))

    def found(text: Column) -> Column:
        first = F.when(venue_category(category).isin(*SPORTS_VENUE) | has(text, SPORTS), "SPORTS")
        for name, words in CATEGORIES.items():
            first = first.when(has(text, words), name)
        return first.otherwise(map_venue_category(category))

    return F.get(F.transform(F.array(F.lower(F.coalesce(question, F.lit("")))), found), 0)


def prefix_id(prefix: str, x: Column) -> Column:
    return F.concat(F.lit(prefix), x)


def json_tokens(x: Column) -> Column:
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def json_first_token(x: Column) -> Column:
    return F.get(json_tokens(x), 0)


def num_or_default(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(known(x.try_cast("double")), F.lit(default))


def iso_ts_or_null(x: Column) -> Column:
    """ISO time in UTC without its zone, null if it is none; each value is read on its own, whatever the session's zone."""
    zoned = F.when(x.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), x).otherwise(F.concat(x, F.lit("Z")))
    return F.timestamp_add("MICROSECOND", F.unix_micros(zoned.try_cast("timestamp")), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def epoch_to_day(seconds: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def series_from_event(series: Column, event: Column) -> Column:
    return F.coalesce(F.nullif(series, F.lit("")), F.split_part(event, F.lit("-"), F.lit(1)))


def trim_text(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def windows_overlap(open_a: Column, close_a: Column, open_b: Column, close_b: Column) -> Column:
    """Closed lifetimes meet; a missing bound is no bound."""
    return F.coalesce(open_a <= close_b, F.lit(True)) & F.coalesce(open_b <= close_a, F.lit(True))
