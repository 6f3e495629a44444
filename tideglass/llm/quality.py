"""Weak-label quality model: expectation-maximisation over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_blocks, gram_hashes, mix64

#: Labellers by name: (measure, bad above, good below); between the two they abstain.
LABELLERS = {
    "symbols": ("symbol_share", 0.05, 0.015),
    "capitals": ("capital_share", 0.40, 0.15),
    "repeats": ("repeat_share", 0.20, 0.05),
    "separators": ("separator_share", 0.15, 0.03),
    "shouting": ("shout_share", 0.25, 0.05),
    "marked_words": ("marked_share", 0.15, 0.03),
    "poor_words": ("same_word_share", 0.75, 0.55),
    "odd_lengths": ("odd_word_share", 0.35, 0.15),
    "no_sentences": ("words_per_stop", 90.0, 40.0),
}
BUCKETS = 1 << 14
GRAM = 3
_BLANK, _LETTER, _CAPITAL, _DIGIT, _PLAIN, _BANG, _STOP = (1 << k for k in range(7))


def class_table() -> np.ndarray:
    """Bits of what each codepoint of the first plane is; higher planes count like its last codepoint."""
    out = np.zeros(1 << 16, dtype=np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        out[k] = _BLANK * c.isspace() | _LETTER * c.isalpha() | _CAPITAL * c.isupper() | _DIGIT * c.isdigit() | _PLAIN * (c in ".,;:!?'\"()-’“”«»¿¡…–—") | _BANG * (c == "!") | _STOP * (c in ".!?。")
    return out


def measures(texts: list[str | None], table: np.ndarray) -> dict[str, np.ndarray]:
    """The labellers' measures of whole texts; a measure a text is too short for is NaN. A word longer than a block of
    codepoints counts as several, and runs of 200 words start anew with a block."""
    n = len(texts)
    sums = {k: np.zeros(n) for k in ("chars", "symbols", "letters", "capitals", "words", "repeats", "lone", "shout", "odd", "stops", "distinct", "marked")}
    add = lambda k, of, w=None: sums.__setitem__(k, sums[k] + np.bincount(of, weights=w, minlength=n))
    for codes, of in code_blocks(texts, 0, whole_words=True):
        kind = table[np.minimum(codes, (1 << 16) - 1)]
        blank = (kind & _BLANK) != 0
        ink = ~blank
        add("chars", of[ink])
        add("symbols", of[ink & ((kind & (_LETTER | _DIGIT | _PLAIN)) == 0)])
        add("letters", of[(kind & _LETTER) != 0])
        add("capitals", of[(kind & _CAPITAL) != 0])
        first = ink.copy()
        first[1:] &= blank[:-1] | (of[1:] != of[:-1])
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        word = np.cumsum(first) - 1
        place = np.arange(len(codes)) - starts[np.maximum(word, 0)]
        value = mix64(codes.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21)))
        value[blank] = 0
        hashes = np.add.reduceat(value, starts)
        length = np.add.reduceat(ink.astype(np.int64), starts)
        owner = of[starts]
        last = kind[starts + length - 1]
        add("words", owner)
        same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        add("repeats", owner[1:][same])
        add("lone", owner[(length == 1) & ((kind[starts] & (_LETTER | _DIGIT)) == 0)])
        add("shout", owner[(last & _BANG) != 0])
        add("marked", owner[(last & (_LETTER | _DIGIT | _PLAIN)) == 0])
        add("stops", owner[(last & _STOP) != 0])
        add("odd", owner[(length > 20) | (length == 1)])
        # words that a run of 200 words has once
        run = np.arange(len(starts)) - np.r_[0, np.flatnonzero(np.diff(owner)) + 1][np.searchsorted(np.flatnonzero(np.diff(owner)) + 1, np.arange(len(starts)), side="right")]
        keys = mix64(hashes ^ ((owner.astype(np.uint64) << np.uint64(32)) + (run // 200).astype(np.uint64)))
        _, index = np.unique(keys, return_index=True)
        add("distinct", owner[index])
    with np.errstate(invalid="ignore", divide="ignore"):
        w, c = sums["words"], sums["chars"]
        enough = lambda x, least: np.where(w >= least, x, np.nan)
        return {
            "symbol_share": np.where(c > 0, sums["symbols"] / c, np.nan),
            "capital_share": np.where(sums["letters"] >= 20, sums["capitals"] / sums["letters"], np.nan),
            "repeat_share": enough(sums["repeats"] / w, 5),
            "separator_share": enough(sums["lone"] / w, 5),
            "shout_share": enough(sums["shout"] / w, 3),
            "marked_share": enough(sums["marked"] / w, 3),
            "same_word_share": enough(1 - sums["distinct"] / w, 30),
            "odd_word_share": enough(sums["odd"] / w, 5),
            "words_per_stop": enough(w / np.maximum(sums["stops"], 0.5), 40),
        }


def votes(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """One row per text, one column per labeller: 0 abstains, 1 good, 2 bad."""
    found = measures(texts, table)
    out = np.zeros((len(texts), len(LABELLERS)), dtype=np.int64)
    for k, (name, bad, good) in enumerate(LABELLERS.values()):
        x = found[name]
        out[:, k] = np.where(np.isnan(x), 0, np.where(x > bad, 2, np.where(x < good, 1, 0)))
    return out


def pattern(found: np.ndarray) -> np.ndarray:
    return found @ (3 ** np.arange(found.shape[1]))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Probability of being good for each vote pattern, and each labeller's accuracy where it votes.

    Two classes; given the class and that it votes, a labeller votes independently of the others, with
    its own chances; abstaining tells nothing. Starts from how many votes are bad and stops when nothing
    moves; a prior of one vote in twenty against the class smooths.
    """
    digits = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    against = (digits == 2).sum(axis=1)
    good = np.array([0.95, 0.35, 0.05])[np.minimum(against, 2)]
    chances = np.zeros((2, len(LABELLERS), 3))
    for _ in range(rounds):
        prior = (np.array([(good * counts).sum(), ((1 - good) * counts).sum()]) + 1) / (counts.sum() + 2)
        for c, p in enumerate((good, 1 - good)):
            for v in (1, 2):
                chances[c, :, v] = ((digits == v) * (p * counts)[:, None]).sum(axis=0) + (0.95 if v == c + 1 else 0.05)
        chances /= chances.sum(axis=2, keepdims=True)
        said_by = np.where(digits > 0, np.log(np.maximum(chances[:, np.arange(len(LABELLERS)), digits], 1e-300)), 0.0)
        logs = np.log(prior)[:, None] + said_by.sum(axis=2)
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    said = (digits > 0) * counts[:, None]
    right = ((digits == 1) * (good * counts)[:, None] + (digits == 2) * ((1 - good) * counts)[:, None]).sum(axis=0)
    return good, right / np.maximum(said.sum(axis=0), 1)


def _named(k: int, v: int) -> int:
    return int(mix64(np.array([1_000_003 * (3 * k + v + 1)], dtype=np.uint64))[0] % BUCKETS)


def gram_buckets(texts: list[str | None], table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash buckets of all n-grams (digits alike, white space alike), and the number of each one's text."""
    for codes, of in code_blocks(texts, GRAM - 1):
        kind = table[np.minimum(codes, (1 << 16) - 1)]
        plain = np.where((kind & _DIGIT) != 0, 48, np.where((kind & _BLANK) != 0, 32, codes))
        h = gram_hashes(plain, GRAM)
        inside = of[: len(h)] == of[GRAM - 1 :] if len(h) else np.empty(0, dtype=bool)
        yield (h[inside] % np.uint64(BUCKETS)).astype(np.int64), of[: len(h)][inside]


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    #: Of the labellers, by name.
    accuracies: dict[str, float]

    def score(self, texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of being good, and vote patterns."""
        n = len(texts)
        total, grams = np.zeros(n), np.zeros(n)
        for bucket, of in gram_buckets(texts, table):
            total += np.bincount(of, weights=self.weights[bucket], minlength=n)
            grams += np.bincount(of, minlength=n)
        found = votes(texts, table)
        named = np.array([[self.weights[_named(k, v)] for v in range(3)] for k in range(len(LABELLERS))])
        z = self.bias + total / np.maximum(grams, 1) * 10 + named[np.arange(len(LABELLERS)), found].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500))), pattern(found)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; rows are (buckets, values, probability)."""
    w, b = np.zeros(BUCKETS), 0.0
    if not rows:
        return w, 4.0
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    bucket, value, y = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.array([r[2] for r in rows])
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, weights=w[bucket] * value, minlength=len(rows)) + b, -500, 500)))
        e = (p - y) / len(rows)
        g = np.r_[np.bincount(bucket, weights=e[of] * value, minlength=BUCKETS) + penalty * w, e.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def sample_texts(texts: DataFrame, share: float) -> DataFrame:
    """About ``share`` of the distinct texts, by a hash of each; a text with very many copies is one row."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(5), "text"), 11) * F.lit(2.0**-53)
    return texts.where(draw < share).select("text").distinct()


def fit(docs: DataFrame, rows: int = 3000) -> Scorer:
    """Labellers vote on every document; accuracies are estimated from the counts of all vote patterns
    (at most 3 to the number of labellers, whatever the input), and the scorer is fitted on at most about ``rows``
    distinct texts, chosen by their hash, with their pattern's posterior."""
    table = class_table()
    texts = docs.where(F.col("text").isNotNull()).select("text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.concatenate([pattern(votes(b.column("text").slice(at, 500).to_pylist(), table)) for at in range(0, b.num_rows, 500)] or [np.empty(0, dtype=np.int64)])
            kind, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(n, pa.int64())], names=["pattern", "n"])

    counted = texts.mapInArrow(vote, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not counted:
        return Scorer(np.zeros(BUCKETS), 4.0, {})
    patterns, counts = np.array([r["pattern"] for r in counted]), np.array([r["n"] for r in counted], dtype=float)
    good, accuracy = expectation_maximisation(patterns, counts)
    posterior = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    different = texts.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).distinct().count()
    sample = sample_texts(texts, min(1.0, rows / different))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.column("text").slice(at, 100).to_pylist()
                parts = list(gram_buckets(part, table))
                found = votes(part, table)
                key = np.concatenate([of * BUCKETS + bucket for bucket, of in parts] or [np.empty(0, dtype=np.int64)])
                key, n = np.unique(key, return_counts=True)
                of = key // BUCKETS
                value = n / np.maximum(np.bincount(of, weights=n, minlength=len(part)), 1)[of] * 10
                cuts = np.searchsorted(of, np.arange(len(part) + 1))
                bucket, value = (key % BUCKETS).astype(np.int32), value.astype(np.float32)
                lists = lambda x, cuts=cuts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([lists(bucket), lists(value), pa.array(pattern(found))], names=["bucket", "value", "pattern"])

    drawn = sample.mapInArrow(features, "bucket array<int>, value array<float>, pattern bigint").toArrow()
    learn = []
    for bucket, value, kind in zip(drawn.column("bucket"), drawn.column("value"), drawn.column("pattern").to_pylist(), strict=True):
        named = [_named(k, kind // 3**k % 3) for k in range(len(LABELLERS))]
        learn.append((np.r_[bucket.values.to_numpy(), named].astype(np.int64), np.r_[value.values.to_numpy(), np.ones(len(named))], posterior[kind]))
    weights, bias = train(learn)
    return Scorer(weights, bias, dict(zip(LABELLERS, accuracy.tolist(), strict=True)))


def _scored(docs: DataFrame, model: Scorer, keep: float | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.accuracies, class_table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, table = shared.value
        model = Scorer(*parts)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                score, kind = model.score(part.column("text").to_pylist(), table)
                if keep is None:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(kind)], names=["doc_id", "score", "votes"])
                else:
                    yield part.filter(pa.array(score >= keep))

    if keep is not None:
        return docs.mapInArrow(run, docs.schema)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, votes bigint")


def score_quality(docs: DataFrame, rows: int = 3000, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, score, keep, votes)``: probability that a whole text is of good quality, the decision at
    ``threshold``, and the labellers' votes in base 3 (0 abstains, 1 good, 2 bad), first labeller lowest.

    Null and empty texts have no measures: all labellers abstain. Repeated rows score alike. Only
    text decides. No rows: none.
    """
    return _scored(docs, fit(docs, rows), None).select("doc_id", "score", (F.col("score") >= threshold).alias("keep"), "votes")


def keep_good(docs: DataFrame, rows: int = 3000, threshold: float = 0.5) -> DataFrame:
    """``docs`` whose score reaches ``threshold``, with all their columns."""
    return _scored(docs, fit(docs, rows), threshold)
