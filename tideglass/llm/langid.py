"""Language ID with language-bitmask n-gram filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_blocks, durable, gram_hashes, mix64

#: Lengths of the n-grams, in letters and single word ends.
SIZES = (3, 5)
UNKNOWN = "und"
_BMP = 1 << 16


def letter_table() -> np.ndarray:
    """For each codepoint of the first plane its small letter, or a blank if it is no letter."""
    out = np.full(_BMP, 32, dtype=np.uint32)
    for k in range(_BMP):
        c = chr(k)
        if c.isalpha():
            small = c.lower()
            out[k] = ord(small) if len(small) == 1 else k
    return out


def _letters(codes: np.ndarray, owners: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small letters and single blanks between words; letters outside the first plane stay as they are."""
    small = table[np.minimum(codes, _BMP - 1)]
    far = codes >= _BMP
    if far.any():
        small[far] = [c if chr(c).isalpha() else 32 for c in codes[far].tolist()]
    blank = small == 32
    keep = np.ones(len(small), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (owners[1:] == owners[:-1]))
    return small[keep], owners[keep]


def grams(texts: list[str | None], table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all n-grams of the texts, block by block, and the number of each one's text.

    Each text counts as if a blank stood before and after it. Where a text goes on in the next block, the last letters of
    this one stand before it, so that each n-gram is counted once.
    """
    framed = (None if t is None else f" {t} " for t in texts)
    tail, owner = np.empty(0, dtype=np.uint32), -1
    for codes, owners in code_blocks(framed, 0):
        small, of = _letters(codes, owners, table)
        if of[0] != owner:
            tail = tail[:0]
        elif tail[-1] == 32 and small[0] == 32:
            small, of = small[1:], of[1:]
        for n in SIZES:
            head = tail[-(n - 1) :]
            joined, whose = np.concatenate([head, small]), np.concatenate([np.full(len(head), owner), of])
            h = gram_hashes(joined, n)
            inside = whose[: len(h)] == whose[n - 1 :] if len(h) else np.empty(0, dtype=bool)
            yield h[inside], whose[: len(h)][inside]
        if len(of):
            own = small[of == of[-1]]
            tail, owner = (np.concatenate([tail, own]) if of[-1] == owner else own)[-(max(SIZES) - 1) :], of[-1]


@dataclass
class LanguageFilter:
    """A Bloom filter that is cut in bit slices: each slot holds one bit per language, and the AND of an
    n-gram's slots is the set of all languages that have it (and now and then one more)."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    common: int

    PROBES = 3
    #: Most bytes of slots, as each executor holds them. More n-grams or languages share them: false positives, which are
    #: corrected, get more frequent.
    MOST = 1 << 30

    @staticmethod
    def positions(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
        h = hashes
        for _ in range(LanguageFilter.PROBES):
            yield (h & np.uint64(size - 1)).astype(np.int64)
            h = mix64(h + np.uint64(0x632BE59BD9B4E019))

    @classmethod
    def build(cls, languages: list[str], hashes: np.ndarray, sets: np.ndarray, common: int = 0) -> LanguageFilter:
        size = 1 << max(12, int(np.ceil(np.log2(max(1, len(hashes)) * 12))))
        words = (len(languages) + 63) // 64 or 1
        while 8 * size * words > cls.MOST and size > 1:
            size //= 2
        slots = np.zeros((size, words), dtype=np.uint64)
        for at in cls.positions(hashes, size):
            np.bitwise_or.at(slots, at, sets)
        fill = np.array([((slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        return cls(languages, slots, fill**cls.PROBES, common)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        out = None
        for at in self.positions(hashes, len(self.slots)):
            out = self.slots[at] if out is None else out & self.slots[at]
        return out

    def predict(self, texts: list[str | None], table: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Popcount of each language's bit over a text's n-grams, less what false positives add; most wins."""
        n, langs = len(texts), len(self.languages)
        hits, total = np.zeros((n, langs)), np.zeros(n)
        for h, of in grams(texts, table):
            if not len(h):
                continue
            m = self.masks(h)
            total += np.bincount(of, minlength=n)
            for k in range(langs):
                bit = (m[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                hits[:, k] += np.bincount(of[bit != 0], minlength=n)
        if not langs:
            return [UNKNOWN] * n, np.zeros(n)
        true = np.clip((hits - self.false_rate * total[:, None]) / (1 - np.minimum(self.false_rate, 0.99)), 0, None)
        best, all_hits = true.argmax(axis=1), true.sum(axis=1)
        best = np.where(all_hits > 0, best, self.common)
        score = np.where(all_hits > 0, true[np.arange(n), best] / np.maximum(all_hits, 1e-12), 0.0)
        return [self.languages[k] if t else UNKNOWN for k, t in zip(best.tolist(), (total > 0).tolist(), strict=True)], np.where(total > 0, score, 0.0)


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the hash of its id's text; a null id is hashed as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, rows_per_language: int = 1500, least_share: float = 0.004, ratio: float = 0.34) -> LanguageFilter:
    """Learn from text and lang of all ``docs`` given.

    Fitted on a sample of at most about ``rows_per_language`` distinct texts of each language (all, if it has
    fewer), chosen by a hash of the text. A language has an n-gram if at least ``least_share`` of its sampled texts
    have it, and at least ``ratio`` times the share of the language that has it most. Ties go to all.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    each = known.select("lang", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).groupBy("lang", "t1", "t2").agg(F.count("*").alias("n"))
    counted = each.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()
    sizes, texts = ({r["lang"]: r[c] for r in counted} for c in ("n", "texts"))
    languages = sorted(sizes)
    table = letter_table()
    if not languages:
        return LanguageFilter([], np.zeros((1, 1), dtype=np.uint64), np.zeros(0), 0)
    spark = docs.sparkSession
    rates = spark.createDataFrame([(x, k, min(1.0, rows_per_language / texts[x])) for k, x in enumerate(languages)], "lang string, number int, rate double")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(11), "text"), 11) * F.lit(2.0**-53)
    sample = durable(known.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("number", "text").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column("number").to_numpy()
            for at in range(0, b.num_rows, 200):
                seen: dict[int, list[np.ndarray]] = {}
                for k, text in zip(number[at : at + 200].tolist(), b.column("text").slice(at, 200).to_pylist(), strict=True):
                    seen.setdefault(k, []).append(np.unique(np.concatenate([h for h, _ in grams([text], table)] or [np.empty(0, dtype=np.uint64)])))
                for k, parts in seen.items():
                    gram, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(np.full(len(gram), k, dtype=np.int32)), pa.array(n)], names=["gram", "number", "n"])

    drawn = {r["number"]: r["n"] for r in sample.groupBy("number").agg(F.count("*").alias("n")).collect()}
    per_language = spark.createDataFrame([(k, 1.0 / n) for k, n in drawn.items()], "number int, one double")
    counts = sample.mapInArrow(run, "gram bigint, number int, n bigint").groupBy("gram", "number").agg(F.sum("n").alias("n"))
    shares = counts.join(F.broadcast(per_language), "number").withColumn("share", F.col("n") * F.col("one")).where(F.col("share") >= least_share)
    tops = shares.groupBy("gram").agg(F.collect_list(F.struct("number", "share")).alias("has"), F.max("share").alias("top"))
    rows = tops.select("gram", F.filter("has", lambda x: x["share"] >= ratio * F.col("top"))["number"].alias("languages")).toArrow()
    words = (len(languages) + 63) // 64
    lists = rows.column("languages").combine_chunks()
    flat = lists.flatten().to_numpy()
    where = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    sets = np.zeros((len(lists), words), dtype=np.uint64)
    np.bitwise_or.at(sets, (where, flat // 64), np.uint64(1) << (flat % 64).astype(np.uint64))
    common = max(range(len(languages)), key=lambda k: sizes[languages[k]])
    return LanguageFilter.build(languages, rows.column("gram").to_numpy().view(np.uint64), sets, common)


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of whole texts.

    Null texts and those without a letter give ``und`` and 0. Score is the winner's part of all
    corrected popcounts; if there are none the most frequent language stands with 0. Ties go to the language
    that is first by name. Only text decides: repeated rows agree. No rows: none.
    """
    table = letter_table()
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.slots, model.false_rate, model.common, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, table = shared.value
        model = LanguageFilter(*parts)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                names, score = model.predict(b.column("text").slice(at, 500).to_pylist(), table)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, 500), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, rows_per_language: int = 1500) -> DataFrame:
    """Fit on documents that aren't held out, then predict all; ``held_out`` tells which."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), rows_per_language)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
