"""Embedding near-duplicates with randomised-rotation binary codes and confidence bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, with_fact
from .graph import Thinner, components, least_reachable

#: Most vectors of a label that one task holds of each side.
TILE = 8192


def rotation(dims: int, bits: int, seed: int = 17) -> np.ndarray:
    """``bits`` x ``dims``: the first columns of a random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :dims])


def code_bits(dims: int) -> int:
    return max(128, 64 * math.ceil(dims / 64))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: rotated vectors, packed signs, and each code's inner product with its own vector."""
    turned = unit @ turn.T
    return turned, np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(len(turn))


def estimate(turned: np.ndarray, codes: np.ndarray, factors: np.ndarray, sigmas: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of vectors (rows) with coded ones (columns), and for each
    coded one how far the estimate is off, but for a chance that falls with the square of ``sigmas``."""
    bits = turned.shape[1]
    signs = np.unpackbits(codes, axis=1)[:, :bits].astype(np.float32) * 2 - 1
    guess = (turned.astype(np.float32) @ signs.T) / (math.sqrt(bits) * factors.astype(np.float32))
    return guess, sigmas * np.sqrt(np.maximum(0, 1 - factors**2)) / (factors * math.sqrt(bits - 1))


def may_link(rough: np.ndarray, codes: np.ndarray, factors: np.ndarray, turn: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``rough``, number of a coded vector) whose cosine can reach ``least``, by estimate and
    bound, slice by slice. ``same``: both sides are one tile, and only pairs of a vector with later ones count."""
    for at in range(0, len(rough), 128):
        guess, off = estimate(rough[at : at + 128].astype(np.float64) @ turn.T, codes, factors)
        may = guess + off >= least
        if same:
            may &= np.arange(len(codes))[None, :] > np.arange(at, at + len(may))[:, None]
        i, j = np.nonzero(may)
        yield i + at, j


def compare(a: np.ndarray, b: np.ndarray | None, weight_a: np.ndarray, weight_b: np.ndarray | None, codes: np.ndarray, factors: np.ndarray, turn: np.ndarray, least: float) -> tuple[np.ndarray, list[tuple[int, int]], int]:
    """Links of cosine at least ``least`` in one tile (b is None) or between two; ``codes`` and ``factors`` are b's (or a's).

    Only pairs that :func:`may_link` gives are computed again, in double precision. Gives for each row (those of b
    counted on) the weight of what it links to, links thinned to a spanning forest, and how many pairs
    were computed.
    """
    other, weight, shift = (a, weight_a, 0) if b is None else (b, weight_b, len(a))
    linked = np.zeros(len(a) + (0 if b is None else len(b)), dtype=np.int64)
    thin, computed = Thinner(len(linked)), 0
    for i, j in may_link(a.astype(np.float32), codes, factors, turn, least, b is None):
        computed += len(i)
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            near = np.einsum("kd,kd->k", a[x], other[y]) >= least
            x, y = x[near], y[near]
            np.add.at(linked, x, weight[y])
            np.add.at(linked, y + shift, weight_a[x])
            ends = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else []
            for k, ys in zip(x[ends].tolist(), np.split(y, ends[1:]), strict=True) if len(x) else ():
                thin.add(k, ys + shift)
    return linked, thin.links, computed


class _Turns(dict):
    """The rotation of each length that a task meets; it keeps few."""

    def __missing__(self, dims: int) -> np.ndarray:
        if len(self) >= 4:
            self.clear()
        turn = self[dims] = rotation(dims, code_bits(dims))
        return turn


def coded(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their ``embedding`` (good ones) as dims, unit (doubles), rough (floats), code and factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = _Turns()
        for b in batches:
            column = b.column("embedding")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            dims = np.diff(offsets)
            made: list[tuple] = [()] * len(dims)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                x = values[offsets[rows][:, None] + np.arange(d)]
                x /= np.abs(x).max(axis=1)[:, None]
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                _, codes, factors = encode(x, turns[d])
                for k, r in enumerate(rows.tolist()):
                    made[r] = (x[k].tobytes(), x[k].astype(np.float32).tobytes(), codes[k].tobytes(), float(factors[k]))
            columns = list(zip(*made, strict=True)) or [()] * 4
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(dims, pa.int32()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[*kept, "dims", "unit", "rough", "code", "factor"])

    kept = [c for c in nodes.columns if c != "embedding"]
    schema = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in kept)
    return nodes.mapInArrow(run, schema + ", dims int, unit binary, rough binary, code binary, factor double")


def _matrix(column: pa.ChunkedArray, dtype: type, rows: np.ndarray, width: int) -> np.ndarray:
    picked = column.take(pa.array(rows)).to_pylist()
    return np.frombuffer(b"".join(picked), dtype=dtype).reshape(len(rows), width)


def link_vectors(nodes: DataFrame, least: float, tile: int | None = None) -> DataFrame:
    """``(a, b, n)`` from a table ``nodes(node, label, weight, dims, unit, rough, code, factor)``: links (b not null), and
    partial counts (b null).

    Only equal labels and lengths meet. A label's vectors of one length, if over ``tile``, are cut into tiles by a hash, and
    each pair of tiles is a group of its own: none grows with the label. What is sent to a pair are
    single-precision vectors of one side, codes and factors of the other; vectors in double precision are
    sent only of those that estimate and bound put in some pair, to the groups in which they are.
    """
    tile = tile or TILE
    sizes = durable(nodes.groupBy("label", "dims").agg(F.count("*").alias("size")).withColumn("n", F.col("size")))
    rows = with_fact(nodes.select("label", "dims", "node", "rough", "code", "factor"), sizes, ["label", "dims"], "n")
    tiles = F.ceil(F.col("size") / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
    dealt = rows.where("size > 1").select("label", "dims", "node", "rough", "code", "factor", own.alias("own"), F.explode(pairs).alias("pair"))
    first, second = F.col("own") == F.col("pair.i"), F.col("own") == F.col("pair.j")
    dealt = dealt.select("label", "dims", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "own", "node", F.when(first, F.col("rough")).alias("rough"), F.when(second, F.col("code")).alias("code"), F.when(second, F.col("factor")).alias("factor"))
    key = ["label", "dims", "i", "j"]
    turns = _Turns()

    def sides(part: pa.Table, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        own = part.column("own").to_numpy()
        return np.flatnonzero(own == i), np.flatnonzero(own == j)

    def search(group: tuple, part: pa.Table) -> pa.Table:
        dims, i, j = (k.as_py() for k in group[1:])
        a, b = sides(part, i, j)
        codes = _matrix(part.column("code"), np.uint8, b, code_bits(dims) // 8)
        factors = part.column("factor").take(pa.array(b)).to_numpy()
        some = np.zeros(part.num_rows, dtype=bool)
        for x, y in may_link(_matrix(part.column("rough"), np.float32, a, dims), codes, factors, turns[dims], least, i == j):
            some[a[x]] = some[b[y]] = True
        rows = part.filter(pa.array(some))
        return rows.select([*key, "own", "node"])

    def exact(group: tuple, part: pa.Table) -> pa.Table:
        dims, i, j = (k.as_py() for k in group[1:])
        a, b = sides(part, i, j)
        order = a if i == j else np.r_[a, b]
        node, weight = part.column("node").to_numpy()[order], part.column("weight").to_numpy()[order]
        unit = _matrix(part.column("unit"), np.float64, order, dims)
        codes, factors = _matrix(part.column("code"), np.uint8, b, code_bits(dims) // 8), part.column("factor").take(pa.array(b)).to_numpy()
        cut = len(a)
        linked, links, _ = compare(unit[:cut], None if i == j else unit[cut:], weight[:cut], None if i == j else weight[cut:], codes, factors, turns[dims], least)
        some = np.flatnonzero(linked)
        ends = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(np.r_[node[some], node[ends[:, 0]]], pa.int64()), "b": pa.array([None] * len(some) + node[ends[:, 1]].tolist(), pa.int64()), "n": pa.array(np.r_[linked[some], np.zeros(len(ends), dtype=np.int64)], pa.int64())})

    kind = nodes.schema["label"].dataType.simpleString()
    found = durable(dealt.groupBy(*key).applyInArrow(search, f"label {kind}, dims int, i int, j int, own int, node bigint"))
    near = found.join(nodes.select("node", "weight", "unit", "code", "factor"), "node")
    return near.groupBy(*key).applyInArrow(exact, "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors(vec_id, embedding, label)``.

    All pairs of equal, non-null labels and equal lengths with cosine at least ``least`` in double precision
    are links. Vectors that are null, zero, or hold a null or non-finite component link with nothing. Equal vectors
    of a label are compared once and count each other. Null vec_id is passed on. No rows: no rows.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", "label", (F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(nonzero, F.lit(False))).alias("good"))
    rows = durable(rows.select("vec_id", "label", "good", F.when(F.col("good"), F.col("embedding")).alias("embedding"), F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding", "label").alias("h2")))
    good = rows.where("good")
    owners = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("owner"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = durable(coded(owners.withColumn("node", F.monotonically_increasing_id())))
    found = durable(link_vectors(nodes, least))
    groups = least_reachable(components(found.where("b is not null").select("a", "b")), nodes.select("node", "owner"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    known = nodes.select("node", "h1", "h2", "owner", "weight").join(groups, "node", "left").join(counts, "node", "left")
    known = durable(known.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("least", "owner").alias("group"), F.col("weight").alias("n")))
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    every = with_fact(good.select("vec_id", "h1", "h2"), known, ["h1", "h2"], "n").select("vec_id", "n_links", F.col("group").cast("long").alias("component_id")).union(alone)
    return every.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
