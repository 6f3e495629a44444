"""Best-fit packing with exact-complement hashing over length counts."""

from __future__ import annotations

import base64
import bisect
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable

CAPACITY = 2048
#: Words whose ids a task keeps at most; the results don't depend on it.
KEPT_WORDS = 200_000
#: Documents whose ids a task holds at once.
ROWS_AT_ONCE = 500
#: The first letter behind the Latin blocks.
LATIN = "ɐ"
_OTHER_SPACE = re.compile(r"[^\S \n]")


class _Words(dict):
    """Ids, as bytes, of a word; computed when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = self[word] = self.encode(word)
        return ids


class Encoder:
    """Ids of ``tokenizers``' vocabulary file, as little-endian unsigned 32-bit bytes.

    A text whose only white space is single blanks and line ends is encoded word by word, as no token
    crosses those; ids of words seen before are looked up, others of the Latin blocks are found with the same
    vocabulary's merge ranks, those of a text all at once. All else goes through the tokenizer itself as a whole.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.part = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.first, self.next = _Words(self._word), {}  # first words of lines, and those after a blank
        self.opens = np.zeros(1 + max(table.values()), dtype=bool)
        self.opens[[n for token, n in table.items() if token.startswith(b" ")]] = True

    def _word(self, word: str) -> bytes:
        if not word.isascii() and max(word) >= LATIN:
            return self._all(word)
        return np.array(self.part.encode_ordinary(word), dtype="<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Ids of ``words``, each after a blank, are known afterwards. New ones of the Latin blocks take one call: a word's ids are those from a token that
        begins with a blank to the next such."""
        new = words.difference(self.next)
        if len(self.next) + len(new) > KEPT_WORDS:
            self.next.clear()
            new = words
        plain = [w for w in new if w.isascii() and w or w and max(w) < LATIN]
        ids = np.array(self.part.encode_ordinary(" " + " ".join(plain)) if plain else [], dtype="<u4")
        coded, bounds = ids.tobytes(), [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
        self.next.update(zip(plain, map(coded.__getitem__, map(slice, bounds, bounds[1:])), strict=True))
        if len(plain) < len(new):
            self.next.update((w, self._word(" " + w)) for w in new.difference(plain))

    def _all(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text) or any(s in text for s in self.special):
            return self._all(text)
        out: list[bytes] = []
        lines = [line.split(" ") for line in text.split("\n")]
        self._learn(set().union(*[words[1:] for words in lines]))
        for k, words in enumerate(lines):
            if k:
                out.append(self.first["\n"])
            out.append(self.first[words[0]])
            out.extend(map(self.next.__getitem__, words[1:]))
        return b"".join(out)


def public_vocabulary() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pieces(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None, capacity: int = CAPACITY, end: int = 0, keep_ids: bool = True) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of whole texts.

    A document is its ids and then ``end``; null text is empty, so it has one id. One longer than ``capacity`` is
    cut so that all pieces but the first are full. ``vocabulary`` holds a tokenizer file, the same
    vocabulary as ranks and its splitting pattern; the files must be on every executor.
    """
    files = vocabulary or public_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = Encoder(*files), np.array([end], dtype="<u4").tobytes()
        for b in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            of, number, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(b.column("text")):
                coded = encode(text.as_py() or "") + last
                n = len(coded) // 4
                at, k = 0, 0
                while at < n:
                    stop = at + ((n - at - 1) % capacity + 1)
                    part = coded[4 * at : 4 * stop]
                    of.append(row)
                    number.append(k)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                    at, k = stop, k + 1
            columns = {"doc_id": b.column("doc_id").take(pa.array(of, pa.int64())), "piece": pa.array(number, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if keep_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


def pair_index(lengths: np.ndarray, capacity: int) -> list[np.ndarray]:
    """For each sum up to ``capacity`` the smaller lengths of its pairs, the most even pair first."""
    has = np.zeros(capacity + 1, dtype=bool)
    has[lengths] = True
    lows = [np.arange(total // 2, 0, -1) for total in range(capacity + 1)]
    return [low[has[low] & has[total - low]] for total, low in enumerate(lows)]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences ``(lengths, how many)`` that hold ``counts[length]`` pieces of each length.

    Gaps of long pieces, which need a sequence each, are filled exactly, and then in one plan gaps of shorter ones too, in another none
    of these: where small pieces are scarcer than gaps, they are better put into gaps that they don't fill. The plan of fewer sequences
    counts, of equal ones the first.
    """
    plans = [fill_plan(counts, capacity, shortest) for shortest in (capacity // 4, capacity // 2)]
    return min(plans, key=lambda kinds: sum(n for _, n in kinds))


def fill_plan(counts: dict[int, int], capacity: int, shortest: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan in which pieces longer than ``shortest`` look for what fills their gap.

    The gap of each length, the longest first, is looked up among single lengths, then again among sums of pairs, then
    sums of three (a smallest length and a pair of at least that length), and each combination that fills
    the gap exactly is used as often as the counts allow. Combinations of the most even lengths come first, so that
    small pieces, which fit anywhere, are left for last. What is left goes, longest first, to the smallest gap
    that holds it. Works on at most ``capacity`` counts, however many pieces there are.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    kinds: Counter = Counter()

    def use(lengths: tuple[int, ...]) -> None:
        need = Counter(lengths)
        n = min(int(left[x]) // m for x, m in need.items())
        if n:
            kinds[tuple(sorted(lengths, reverse=True))] += n
            for x, m in need.items():
                left[x] -= n * m

    pairs = pair_index(np.flatnonzero(left), capacity)

    def fill(a: int, total: int, least: int, rest: tuple[int, ...]) -> None:
        """Use ``a`` and ``rest`` with the pairs of that total whose lengths are ``least`` or more."""
        low = pairs[total]
        for b in low[(low >= least) & (left[low] > 0) & (left[total - low] > 0)].tolist():
            use((a, total - b, b, *rest))
            if not left[a]:
                break

    longest = range(capacity, shortest, -1)  # four pieces of which the longest is a quarter at most aren't enough
    for a in longest:
        if left[a]:
            use((a, capacity - a) if a < capacity else (a,))
    for a in longest:
        if left[a] and capacity - a > 1:
            fill(a, capacity - a, 1, ())
    for a in longest:
        for d in range((capacity - a) // 3, 0, -1):
            if not left[a]:
                break
            if left[d]:
                fill(a, capacity - a - d, d, (d,))
    # the rest: open sequences by their gap
    opened: dict[int, Counter] = {}
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in opened:
            opened[gap] = Counter()
            bisect.insort(gaps, gap)
        opened[gap][lengths] += n

    for a in range(capacity, 0, -1):
        n = int(left[a])
        while n:
            at = bisect.bisect_left(gaps, a)
            if at == len(gaps):
                each = capacity // a
                if n >= each:
                    put((a,) * each, n // each)
                if n % each:
                    put((a,) * (n % each), 1)
                break
            gap = gaps[at]
            lengths, there = opened[gap].popitem()
            each = min(gap // a, n)
            k = min(there, n // each)
            if there > k:
                opened[gap][lengths] = there - k
            if not opened[gap]:
                del opened[gap], gaps[at]
            put(lengths + (a,) * each, k)
            n -= k * each
    for group in opened.values():
        kinds.update(group)
    return sorted(kinds.items())


def slots(kinds: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, rank after, first sequence, pieces of it in each, offset)``: where pieces go
    by their rank among those of their length."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for lengths, n in kinds:
        at = 0
        for length, each in Counter(lengths).items():
            first = rank[length]
            rank[length] += n * each
            rows.append((length, first, rank[length], sequence, each, at))
            at += length * each
        sequence += n
    return rows


def _table(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """Whole numbers of the driver as a table. They go there in Arrow: rows of Python objects would be read by Python workers of another kind on
    every executor, which stay there beside those that encode."""
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, columns, strict=True)}))


def pack(found: DataFrame, capacity: int = CAPACITY, parts: int = 1 << 15) -> DataFrame:
    """``found`` (doc_id, piece, length and others) with ``sequence_id`` and ``offset``.

    Only counts of the at most ``capacity`` lengths and the plan made of them are on the driver.
    Ranks within a length are counted in salted parts, about ``parts`` over all lengths by their counts, so
    that a length that many pieces have is not one task; the tables of lengths, places and parts are
    bounded by capacity and ``parts``, whatever the input. Reruns agree. No pieces: none.
    """
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _table(spark, slots(plan(counts, capacity)), ["slot_length", "low", "high", "sequence", "each", "at"])
    total = sum(counts.values())
    share = _table(spark, [(x, -(-n * parts // total)) for x, n in counts.items()], ["length", "parts"])
    dealt = found.join(F.broadcast(share), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts"))).drop("parts")
    sizes = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    sizes = durable(sizes.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(before, F.lit(0)).alias("before")))
    order = W.partitionBy("length", "salt").orderBy(*[c for c in ("doc_id", "piece", "start", "ids_crc32") if c in found.columns])
    ranked = dealt.withColumn("k", F.row_number().over(order) - 1)
    ranked = ranked.join(sizes, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("before") + F.col("k"))
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return placed.select(*found.columns, (F.col("sequence") + F.expr("(rank - low) div each")).alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places, without ids: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Texts are encoded once; the pieces are a table in the shared folder. Needs
    doc_id and text; other columns are not looked at. Repeated rows are packed each."""
    return pack(durable(pieces(docs, vocabulary, capacity, keep_ids=False)), capacity)


def sequences(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``(sequence_id, ids)``: the packed sequences themselves, each of at most ``capacity`` ids."""
    placed = pack(durable(pieces(docs, vocabulary, capacity)), capacity)
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
