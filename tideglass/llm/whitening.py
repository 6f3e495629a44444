"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation over distributed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Rows that a task holds as a matrix at once.
AT_ONCE = 4096
#: Entries are scaled and moved to whole numbers.
SCALE, SHIFT = 64, 1_000_000
#: Numbers in a stored matrix.
BLOCK = 1 << 17
#: Largest absolute entry; beyond it sums of whole numbers could leave 64 bits.
LARGEST = float(1 << 50)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x)``: usable vectors as whole numbers. Not usable are vectors that are null or empty, or hold null, non-finite
    entries or such beyond LARGEST."""
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)) & (F.size("embedding") > 0)
    rows = vectors.where(F.coalesce(usable, F.lit(False)))
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            part = b.slice(at, AT_ONCE)
            column = part.column("x")
            yield part, column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _blocks(rows: DataFrame, dims: int) -> DataFrame:
    """``rows(x)``, all of ``dims`` numbers, as a table of matrices: one value of bytes for up to BLOCK numbers, as each pass would else
    take every number out of an array again."""
    most = max(1, BLOCK // dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(b.column("x").flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(b.num_rows, dims)
            yield pa.RecordBatch.from_arrays([pa.array([x[at : at + most].tobytes() for at in range(0, len(x), most)], pa.binary())], names=["block"])

    return durable(rows.select("x").mapInArrow(run, "block binary"))


def _summed(blocks: DataFrame, dims: int, part) -> np.ndarray:
    """``part(matrix)``, an array of one length, summed over all ``blocks``. Each task gives one row of sums and
    Spark adds them up by place, so the driver gets one array however many tasks there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for block in b.column("block"):
                own = part(np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(-1, dims))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    sums = blocks.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"))
    found = sorted(sums.collect())
    return np.array([r.s for r in found])


def _moved(x: np.ndarray, n: int, totals: np.ndarray) -> np.ndarray:
    """n x - S in whole numbers: of 64 bits, or of any size if ``totals`` are."""
    return x.astype(totals.dtype) * n - totals


def _centre(x: np.ndarray, n: int, totals: np.ndarray) -> np.ndarray:
    """Rows less their mean: whole numbers, which lose nothing, then one division."""
    return _moved(x, n, totals).astype(np.float64) / n


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows of ``rows(x)`` and the exact sum of each dimension."""
    found = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s")).orderBy("at").collect()
    return (found[0].n if found else 0), [int(r.s) for r in found]


def bidiagonalise(blocks: DataFrame, n: int, totals: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(V, B)``: A V = U B for the centred rows A that ``blocks`` hold, with orthonormal V (dims x k) and upper bidiagonal B.

    Step j multiplies A by v_j, takes away what lies along the earlier u's (in exact arithmetic only the last of
    them), and multiplies A' by the new u_j; what is left of that, orthogonal to all v's, is the next v. Both sides are
    orthogonalised fully. A u has one entry per row, so it is never stored: u_j = A y_j for a vector y_j of one entry per dimension, and a
    task makes its rows' part of all u's from Y again. As A'u is known for the earlier u's, both products and all inner products
    of a step are one pass over the rows; the driver holds V, Y and B, all of the size of the dimensions.

    There is one step per dimension. Where nothing is left (a repeated or a zero deviation), the next v is
    a random one that is orthogonal to all before, so no direction is lost.
    """
    dims = len(totals)
    rng = np.random.default_rng(seed)
    v_all, y_all, t_all, b_all = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims, dims))
    scale = 0.0

    def away(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - v_all @ (v_all.T @ v)
        return v

    def fresh() -> np.ndarray:
        v = away(rng.standard_normal(dims))
        return v / np.linalg.norm(v)

    v = fresh()
    for j in range(dims):
        z, ys = v - (b_all[j - 1, j] * y_all[:, -1] if j else 0), y_all

        def products(x: np.ndarray, z: np.ndarray = z, ys: np.ndarray = ys) -> np.ndarray:
            a = _centre(x, n, totals)
            w = a @ z
            return np.r_[w @ w, a.T @ w, (w @ a) @ ys]

        found = _summed(blocks, dims, products)
        square, back, along = found[0], found[1 : 1 + dims], found[1 + dims :]
        z, back = z - y_all @ along, back - t_all @ along
        alpha = np.sqrt(max(0.0, square - along @ along))
        scale = max(scale, alpha)
        v_all = np.c_[v_all, v]
        if alpha > 1e-12 * scale:
            y, t = z / alpha, back / alpha
        else:
            alpha, y, t = 0.0, np.zeros(dims), np.zeros(dims)
        y_all, t_all, b_all[j, j] = np.c_[y_all, y], np.c_[t_all, t], alpha
        if j + 1 < dims:
            rest = away(t - alpha * v)
            beta = np.linalg.norm(rest)
            if beta > 1e-12 * scale:
                v, b_all[j, j + 1] = rest / beta, beta
            else:
                v = fresh()
    return v_all, b_all


def components(blocks: DataFrame, n: int, totals: np.ndarray, most: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """``(directions, eigenvalues)`` of the covariance of the rows that ``blocks`` hold, at most ``most``, largest first; those of deviation
    zero (under 1e-9 of the largest) are left out."""
    v, b = bidiagonalise(blocks, n, totals)
    _, deviations, right = np.linalg.svd(b)
    keep = deviations[:most] > 1e-9 * max(deviations[:1].max(initial=0.0), 1e-300)
    return (v @ right.T)[:, :most][:, keep], deviations[:most][keep] ** 2 / n


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: one row per usable vector of
    ``vectors(vec_id, embedding)`` and component.

    Vectors that are null or empty or hold null, non-finite or absurd entries (beyond 2^50) have no rows; nor have
    those of another length than the one that most vectors have (of equally many, the longer), as a covariance
    has one length. Components with no deviation have no rows, so equal vectors, or one alone, give none. Null ids and
    repeated rows are rows like others. ``deviation`` is null if it is no 64-bit number. Extra columns aren't read.
    """
    rows = durable(whole_vectors(vectors))
    lengths = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths or lengths[0].n < 2:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths[0].dims)
    n, sums = exact_sums(rows)
    totals = np.array(sums, dtype=object)
    # n x - S fits 64 bits if it does for the largest entry; else numbers of any size are used
    largest = rows.agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c))))).first()[0]
    fits = 2 * n * max(largest, 1) < 1 << 63
    totals = totals.astype(np.int64) if fits else totals
    dims = lengths[0].dims
    blocks = _blocks(rows, dims)
    directions, values = components(blocks, n, totals, most)
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    project = directions / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        a = _centre(x, n, totals)
        w = a @ project
        return np.r_[np.square(a).sum(), w.sum(axis=0), (w.T @ w).ravel()]

    found = _summed(blocks, dims, moments)
    trace, found = found[0] / n, found[1:]
    mean = found[:k] / n
    error = float(np.abs(found[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = (values / trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _matrices(batches):
            moved = _moved(x, n, totals)
            whitened = (moved.astype(np.float64) / n) @ project
            most_moved = int(np.abs(moved).max())
            if most_moved * most_moved * len(totals) < 1 << 63:
                deviation = pa.array(np.square(moved).sum(axis=1).astype(np.int64))
            else:
                whole = [sum(int(c) ** 2 for c in row) for row in moved.tolist()]
                deviation = pa.array([d if d < 1 << 63 else None for d in whole], pa.int64())
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            columns = [b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(at), pa.array(whitened.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
