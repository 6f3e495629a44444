"""Mixing sources to target weights: floor(rate) copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, free_name

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: What is not one of these characters belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of ``sizes(source, source_size)``, which has one row per source.

    All targets together are ``share`` of all sizes, dealt by weight; none is above ``most`` times
    its source's size, and the excess goes to the others by weight. Filling stops at one level for
    every source below its limit, so sources sorted by limit over weight are full up to some place
    and level after it. ``share`` above ``most`` fills all. The windows run over one row per source.
    """
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (n % len(weights) + 1).cast("int"))
    full = sizes.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    full = full.withColumn("ratio", F.col("limit") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    all_rows = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    full = full.withColumns({"total": share * F.sum("source_size").over(all_rows), "weights": F.sum("weight").over(all_rows), "limits_before": F.coalesce(F.sum("limit").over(before), F.lit(0.0)), "weights_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    full = full.withColumn("level", (F.col("total") - F.col("limits_before")) / (F.col("weights") - F.col("weights_before")))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_rows)
    full = full.withColumn("level", F.coalesce(first["level"], F.lit(float("inf"))))
    return full.select("source", "source_size", "weight", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def coin(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed only: the first 48 bits of an MD5 of both as text. A null
    key is an empty one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") * F.lit(2.0**-48)


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"))


def with_copies(docs: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` (doc_id, source and others) with ``mix_copies`` and its source's figures in ``mix``.

    ``targets`` has one row per source. Ids are hashed, so a row's copies don't depend on partitions;
    rows with the same id toss the same coin, null ids share one. Null source is a source.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    right = targets.select(F.struct("source_size", "target", rate.alias("rate")).alias("mix"), F.col("source").alias("mix_source"))
    joined = docs.join(right, docs["source"].eqNullSafe(right["mix_source"]), "left").drop("mix_source")
    whole = F.floor("mix.rate")
    return joined.withColumn("mix_copies", (whole + (coin(F.col("doc_id"), seed) < F.col("mix.rate") - whole).cast("long")).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """Every document as many times as the mix takes it, with the columns it came with.

    Needs doc_id, text, source. Null or wordless texts count no words but are drawn at their source's
    rate; a source without words gives nothing. No documents: none. Repeated rows are drawn alike.
    Columns named like ours come back unchanged.
    """
    targets = durable(source_targets(sizes_of(docs), weights, share, most))
    drawn, columns = free_name(docs, "mix_row"), docs.columns
    packed = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in columns]).alias(drawn))
    taken = with_copies(packed, targets, seed).where("mix_copies > 0")
    repeated = taken.select(drawn, F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"))
    return repeated.select(f"{drawn}.*")


def mix_report(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """What :func:`mix` takes of each document: doc_id, size, source_size, target, taken, copies.

    Words are counted once; ids, sources and counts are kept in the shared folder, not the texts.
    """
    sizes = durable(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    drawn = with_copies(sizes, durable(targets), seed)
    return drawn.select("doc_id", "size", F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target"), (F.col("size") * F.col("mix_copies")).alias("taken"), F.col("mix_copies").alias("copies"), "source")
