"""Shared pieces of the training-data operators: tables, codepoint blocks and hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, durable, scope, shared_dir, with_fact  # noqa: F401  (for the operators)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for a text; a null text has its own."""
    some = text.isNotNull()
    return F.xxhash64(some, text), F.xxhash64(F.lit(1), text, some)


def sift(rows: DataFrame, keys: list[Column], listed: DataFrame, bits: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``keys`` may be among the rows of ``listed``, a table of just those columns, and those
    whose keys are not.

    A bitmap of ``bits`` places, 8 MB whatever the input, is built of the hashes of ``listed`` and broadcast, so
    that only rows of the first kind need to be sent to a join. Null keys are keys. The more of its places are
    taken the more rows pass in vain; none is ever missed. ``rows`` is read twice.
    """
    at = lambda columns: F.pmod(F.xxhash64(F.lit(len(columns)), *columns), F.lit(bits))
    place = at([F.col(c) for c in listed.columns])
    maps = durable(listed.groupBy(F.bitmap_bucket_number(place).alias("sift_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("sift_map")))
    own = at(keys)
    marked = rows.withColumn("sift_at", own).join(F.broadcast(maps), F.bitmap_bucket_number(own) == F.col("sift_bucket"), "left")
    bit = F.bitmap_bit_position(F.col("sift_at"))
    byte = F.conv(F.hex(F.substring(F.col("sift_map"), (F.floor(bit / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (bit % 8).cast("int")) % 2 == 1, F.lit(False))
    return tuple(marked.where(x).select(*[rows[f"`{c}`"] for c in rows.columns]) for x in (hit, ~hit))


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` in one column ``row``, beside which helper columns may have any name; ``row.*`` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def row_keys(row: str = "row") -> list[Column]:
    """Two hashes that stand for a packed row's doc_id and text."""
    none, doc, t = F.col(f"{row}.doc_id").isNull(), F.col(f"{row}.doc_id"), F.col(f"{row}.text")
    return [F.xxhash64(F.lit(k), none, doc, *text_key(t)) for k in (0, 1)]


def split_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Packed ``rows`` (column ``row``) in two: one of each doc_id and text, and the further rows that repeat both; None if there
    are none. Only rows that repeat are written, told apart by a number, and a document that very many rows repeat is no single task."""
    k1, k2 = row_keys()
    twice = durable(rows.groupBy(k1.alias("k1"), k2.alias("k2")).agg(F.count("*").alias("n")).where("n > 1"))
    if twice.isEmpty():
        return rows, None
    may, others = sift(rows, [k1, k2], twice.select("k1", "k2"))
    may = durable(may.select("row", k1.alias("k1"), k2.alias("k2"), F.monotonically_increasing_id().alias("id")))
    first = durable(may.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    numbered = with_fact(may, first, ["k1", "k2"], "n")
    return others.select("row").union(numbered.where("id = first").select("row")), numbered.where("id > first").select("row")


#: Codepoints of a block, about.
BLOCK = 1 << 19


def code_blocks(texts: Iterable[str | None], overlap: int, whole_words: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codepoints of many texts in blocks of about BLOCK, with the number of each one's text.

    A text longer than a block continues in the next one, which repeats its last ``overlap``
    codepoints, so that every window of ``overlap + 1`` codepoints is in exactly one block. ``whole_words``: it is
    cut after a blank, line end or tab, so that only a word longer than a block is cut.
    """
    limit = BLOCK
    held: list[str] = []
    owners: list[int] = []
    size = 0

    def block():
        codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return codes, np.repeat(np.array(owners, dtype=np.int64), [len(x) for x in held])

    for k, text in enumerate(texts):
        at, n = 0, len(text or "")
        while at < n:
            part = text[at : at + limit]
            if whole_words and at + len(part) < n:
                part = part[: max(part.rfind(c) for c in " \n\t") + 1] or part
            held.append(part)
            owners.append(k)
            size += len(part)
            done = at + len(part) >= n
            at = n if done else at + max(1, len(part) - overlap)
            if size >= limit:
                yield block()
                held, owners, size = [], [], 0
    if held:
        yield block()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a rolling hash depends on all its codepoints."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of ``n`` codepoints (as many as ``len(codes) - n + 1``)."""
    if len(codes) < n:
        return np.empty(0, dtype=np.uint64)
    c = codes.astype(np.uint64)
    h = np.full(len(c) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : len(c) - n + 1 + k]
    return mix64(h)
