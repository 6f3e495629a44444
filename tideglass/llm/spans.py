"""Regular-expression matches with their places, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CUT = "array<struct<m:string,gap:int,n:int,before:string,after:string>>"
_SPAN = "array<struct<start:int,end:int,m:string,before:string,after:string>>"
#: Characters kept of what stands before a match (no further back than the last match of its kind).
BEFORE = 32
#: Values of an array that one block has.
BLOCK = 128


def all_matches(text: Column, regex: str, possible: Column | None = None) -> Column:
    """Leftmost non-overlapping matches; ``possible`` is a cheap test that texts with a match pass."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    return found if possible is None else F.when(possible, found).otherwise(F.array().cast("array<string>"))


def cut_at(text: Column, matches: Column, regex: str) -> Column:
    """``matches`` with their lengths, how far each is from the last one, and what stands before and after.

    The text is split by the same expression, so that lengths of the parts between add up to places.
    """
    parts = F.split(text, regex, -1)
    rows = F.arrays_zip(parts.alias("p"), matches.alias("m"), F.slice(parts, 2, 2147483647).alias("q"))
    rows = F.transform(rows, lambda x: F.struct(x["m"].alias("m"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("n"), F.right(x["p"], F.lit(BEFORE)).alias("before"), F.left(x["q"], F.lit(1)).alias("after")))
    return F.when(F.size(matches) > 0, F.filter(rows, lambda x: x["m"].isNotNull())).otherwise(F.array().cast(_CUT))


def in_blocks(column: str) -> Column:
    """An array column that is not empty in blocks of at most BLOCK.

    The column is named twice, so that it is computed once per row, not once per block.
    """
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(column) - 1) / BLOCK).cast("int")), lambda i: F.slice(column, i * BLOCK + 1, F.lit(BLOCK)))


def placed(column: str) -> Column:
    """Column of :func:`cut_at` with start and end in codepoints.

    A fold copies what it has gathered at each step, so places are added up per block, from where it starts.
    """
    none = F.array().cast(_SPAN)
    blocks = F.transform(in_blocks(column), lambda b: F.struct(b.alias("rows"), F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["n"]).alias("n")))
    step = lambda acc, b: F.struct((acc["at"] + b["n"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    starts = F.aggregate(F.transform(blocks, lambda b: F.struct(b["n"].alias("n"))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["n"]
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    found = F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("at")), lambda z: F.aggregate(z["b"]["rows"], F.struct(z["at"].alias("at"), none.alias("out")), one, lambda acc: acc["out"]))
    return F.when(F.size(column) > 0, F.flatten(found)).otherwise(none)


def with_blocks(rows: DataFrame, spans: str, name: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``name``: column ``spans`` by start in blocks, each with its first start and last end. ``more`` fields are kept."""
    fields = lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", *more)])
    ends = F.array_sort(F.transform(spans, fields))
    block = lambda b: F.struct(b[0]["start"].alias("low"), F.array_max(F.transform(b, lambda s: s["end"])).alias("high"), b.alias("spans"))
    return rows.withColumn(name, ends).withColumn(name, F.when(F.size(name) > 0, F.transform(in_blocks(name), block)))


def overlaps(blocks: str, s: Column, which: Callable[[Column], Column] | None = None) -> Column:
    """Whether ``s`` overlaps one of the spans of column ``blocks`` (of those for which ``which`` is true), which is named twice for the same reason."""
    meets = lambda low, high: (low < s["end"]) & (s["start"] < high)
    one = lambda x: meets(x["start"], x["end"]) if which is None else meets(x["start"], x["end"]) & which(x)
    return F.col(blocks).isNotNull() & F.exists(blocks, lambda b: meets(b["low"], b["high"]) & F.exists(b["spans"], one))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a number of at most 20 digits passes the Luhn check."""
    padded = F.lpad(number, 20, "0")
    total = F.lit(0)
    for k in range(20):
        d = F.substring(padded, k + 1, 1).cast("int")
        total = total + (d if k % 2 else F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    return total % 10 == 0


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start, then by kind as listed, joined by commas; spans are structs with start, kind
    (its number), end."""
    name = F.array(*[F.lit(k) for k in kinds])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat(F.element_at(name, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
