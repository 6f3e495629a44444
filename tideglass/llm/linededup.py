"""Line dedup by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name, packed, sift, split_copies, text_key, with_fact

#: Lines of a window.
WINDOW = 3


def pieces(text: Column) -> Column:
    """The lines of a text, as structs of line (its number) and piece.

    A line is what stands between line ends, cut after each of ``. ! ?`` that a blank follows, as a paragraph on one
    line would else be one line however long it is.
    """
    cut = lambda x: F.split(x, "(?<=[.!?] )", -1)
    return F.flatten(F.transform(F.split(text, "\n", -1), lambda x, k: F.transform(cut(x), lambda p: F.struct(k.alias("line"), p.alias("piece")))))


def _plain(piece: Column) -> Column:
    """A piece without white space at its ends, by which it is compared."""
    return F.btrim(piece, F.lit(" \t\r\v\f"))


def repeated_pieces(docs: DataFrame) -> DataFrame:
    """``(doc_id, t1, drop)``: for each text that loses lines, the numbers (from 0) of those pieces; t1 is its hash.

    Windows are three pieces in a row; a text of one or two pieces is one window. A window all of whose
    pieces are blank is none. Windows with equal pieces are one passage: its first place by (doc_id, text hash,
    piece) stays, and all pieces of its later places go, overlapping places merged. The first place of any
    piece never goes, so no words are lost. Two 64-bit hashes stand for a window. Rows are told apart by doc_id and
    text (its 64-bit hash, which tells apart the texts of one doc_id); rows that share both count once. A bitmap of the repeated windows keeps most of the others out of the join.
    """
    plain = F.transform(pieces(F.col("text")), lambda p: _plain(p["piece"]))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", text_key(F.col("text"))[0].alias("t1"), plain.alias("p"))
    rows = rows.select("doc_id", "t1", F.transform("p", lambda p: F.xxhash64(p)).alias("a"), F.transform("p", lambda p: F.xxhash64(F.lit(WINDOW), p)).alias("b"))
    next_ones = lambda c, k: F.slice(c, k + 1, F.lit(2147483647)).alias(f"{c}{k}")
    names = [f"{c}{k}" for c in "ab" for k in range(WINDOW)]
    zipped = F.arrays_zip(*[next_ones(c, k) for c in "ab" for k in range(WINDOW)])
    windows = rows.select("doc_id", "t1", F.posexplode(zipped).alias("piece", "w")).select("doc_id", "t1", "piece", *[F.col("w")[n].alias(n) for n in names])
    windows = windows.where(F.col(names[WINDOW - 1]).isNotNull() | (F.col("piece") == 0))
    nothing = F.xxhash64(F.lit(""))
    windows = windows.where(F.greatest(*[F.coalesce(F.col(f"a{k}") != nothing, F.lit(False)) for k in range(WINDOW)]))
    windows = windows.select("doc_id", "t1", "piece", *[F.xxhash64(F.lit(WINDOW), *names[k * WINDOW : (k + 1) * WINDOW]).alias(h) for k, h in enumerate(("h1", "h2"))])
    windows = durable(windows)
    place = F.struct("doc_id", "t1", "piece")
    firsts = durable(windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first <> last").drop("last"))
    may, _ = sift(windows, [F.col("h1"), F.col("h2")], firsts.select("h1", "h2"))
    later = with_fact(durable(may), firsts, ["h1", "h2"], "n").where(place > F.col("first")).select("doc_id", "t1", "piece")
    covered = later.groupBy("doc_id", "t1").agg(F.collect_set("piece").alias("starts"))
    drop = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + WINDOW - 1)))))
    return covered.select("doc_id", "t1", drop.alias("drop"))


def _all_covered(text: Column) -> Column:
    """Numbers of the pieces in windows of a text that aren't all blank."""

    def of(plain: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(plain) - WINDOW, F.lit(0)))
        told = F.filter(starts, lambda i: F.exists(F.slice(plain, i + 1, F.lit(WINDOW)), lambda p: p != ""))
        return F.array_sort(F.array_distinct(F.flatten(F.transform(told, lambda i: F.sequence(i, i + WINDOW - 1)))))

    return F.get(F.transform(F.array(F.transform(pieces(text), lambda p: _plain(p["piece"]))), of), 0)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later places of repeated three-line passages cut from ``text``, and ``n_lines``,
    ``n_removed`` (lengthened by underscores if the input has such columns): the lines it had, and the
    pieces that were cut.

    Pieces that stay keep their line ends; a line that loses all its pieces goes. Null text stays null with 0
    lines; an empty text has one line. Null doc_id comes first in order. A whole copy of a short
    text loses all of it. No rows: no rows. Rows that repeat a doc_id with another text are rows of their own; of rows that repeat both
    one is cleaned as if it were alone, and the others lose whatever stands in a window, as that stands in the first. Columns may have any names.
    """
    n_lines, n_removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    rows, copies = split_copies(packed(docs))
    found = repeated_pieces(docs.select("doc_id", "text"))
    found = durable(found.select(*[F.xxhash64(F.lit(k), F.col("doc_id").isNull(), "doc_id", "t1").alias(f"k{k}") for k in (0, 1)], "drop"))
    key = [F.xxhash64(F.lit(k), F.col("row.doc_id").isNull(), F.col("row.doc_id"), text_key(F.col("row.text"))[0]) for k in (0, 1)]
    may, others = sift(rows, key, found.select("k0", "k1"))
    none = F.lit(None).cast("array<int>")
    split = may.select("row", *[k.alias(f"k{i}") for i, k in enumerate(key)]).join(found, ["k0", "k1"], "left").select("row", "drop").union(others.select("row", none))
    if copies is not None:
        split = split.union(copies.select("row", F.when(F.col("row.text").isNotNull(), _all_covered(F.col("row.text")))))
    split = split.withColumn("pieces", F.when(F.col("drop").isNotNull(), pieces(F.col("row.text"))))
    split = split.withColumn("drop", F.filter(F.col("drop"), lambda i: i < F.size("pieces")))
    split = split.withColumn("left", F.transform(F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), "drop"), lambda i: F.get("pieces", i)))
    new_line = lambda p, k: F.when((k > 0) & (F.get("left", k - 1)["line"] < p["line"]), F.concat(F.lit("\n"), p["piece"])).otherwise(p["piece"])
    text = F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform("left", new_line), ""))
    kept = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    count_lines = F.coalesce(F.length("row.text") - F.length(F.replace("row.text", F.lit("\n"))) + 1, F.lit(0)).cast("long")
    n_gone = F.coalesce(F.when(F.col("drop").isNotNull(), F.size("drop")), F.lit(0)).cast("long")
    return split.select(*kept, count_lines.alias(n_lines), n_gone.alias(n_removed))
