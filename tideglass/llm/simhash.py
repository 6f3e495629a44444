"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check."""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, mix64, packed, row_keys, sift, split_copies, text_key, with_fact
from .graph import Thinner, components, least_reachable

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A fingerprint's 64 bits are 32 segments of 2 bits, dealt to this many groups.
GROUPS = 6
#: Most fingerprints of one cell that are compared in one task; larger cells are cut into tiles.
TILE = 4096


def shingle_hashes(text: str | None, n: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``n`` words (fewer words: of all of them; none: nothing)."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    ends = ends.tolist()
    k = min(n, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s : e - 1], seed) for s, e in zip([0, *ends[: len(ends) - k]], ends[k - 1 :], strict=True)], dtype=np.uint64)


def _majority(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """The 64 bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), block):
        ones += np.unpackbits(hashes[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    return _majority(shingle_hashes(text, n, seed))


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` of whole texts; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), n, seed) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _counts(fp: str) -> Column:
    """Popcounts of the 32 segments of 2 bits, each in its segment's place."""
    return F.expr(f"shiftleft({fp} & shiftrightunsigned({fp}, 1) & 6148914691236517205L, 1) | (({fp} ^ shiftrightunsigned({fp}, 1)) & 6148914691236517205L)")


def _cells(fps: DataFrame, reach: int) -> DataFrame:
    """``(node, choice, at)``: grid cells of each fingerprint, which is its own node.

    The embedding is the vector of popcounts of 2-bit segments, whose Manhattan distance is a lower
    bound of the differing bits. Segments lie in GROUPS groups; vectors within ``reach`` differ in at
    most ``reach`` groups, so they agree in all coordinates of some GROUPS - reach of them: the cells
    are those choices with their coordinates, and every pair within reach meets in one at least.
    """
    bits = [list(range(g, 32, GROUPS)) for g in range(GROUPS)]
    masks = []
    for k, chosen in enumerate(itertools.combinations(range(GROUPS), GROUPS - reach)):
        mask = sum(3 << (2 * s) for g in chosen for s in bits[g])
        masks.append((k, mask - (1 << 64) if mask >> 63 else mask))
    choices = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("choice"), F.lit(m).cast("long").alias("mask")) for k, m in masks])
    return fps.select("fp", _counts("fp").alias("counts"), F.explode(choices).alias("c")).select(F.col("fp").alias("node"), F.col("c.choice").alias("choice"), F.col("counts").bitwiseAND(F.col("c.mask")).alias("at"))


def _forest(a: np.ndarray, b: np.ndarray | None, reach: int) -> list[tuple[int, int]]:
    """Links within reach in one tile (b is None) or between two, thinned to a spanning forest.

    Rows are fingerprints of one or more 64-bit words. They are compared in slices: popcounts of the
    bytes give the Manhattan lower bound, and only what passes it is compared bit by bit. Gives row
    numbers, those of b counted on from those of a.
    """
    other, shift = (a, 0) if b is None else (b, len(a))
    every = len(a) + (0 if b is None else len(b))
    thin = Thinner(every)
    parts = lambda x: np.bitwise_count(np.ascontiguousarray(x).view(np.uint8)).astype(np.int8).T.copy()
    theirs = parts(other)
    for at in range(0, len(a), 128):
        rows = a[at : at + 128]
        bound = np.zeros((len(rows), len(other)), dtype=np.int16)
        for mine, their in zip(parts(rows), theirs, strict=True):
            bound += np.abs(mine[:, None] - their[None, :])
        i, j = np.nonzero(bound <= reach)
        if b is None:
            i, j = i[j > i + at], j[j > i + at]
        near = np.zeros(len(i), dtype=np.int64)
        for w in range(a.shape[1]):
            near += np.bitwise_count(rows[i, w] ^ other[j, w])
        i, j = i[near <= reach], j[near <= reach]
        ends = np.searchsorted(i, np.arange(len(rows) + 1))
        for k in range(len(rows)):
            if ends[k] < ends[k + 1]:
                thin.add(at + k, j[ends[k] : ends[k + 1]] + shift)
    return thin.links


def links(cells: DataFrame, reach: int, words: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` between nodes of ``cells(node, choice, at)`` that differ in at most ``reach`` bits.

    ``words(node, w0, w1, ...)`` has the fingerprints; without it a node is its own fingerprint. Links
    are thinned: of those of one cell, or of two tiles of it, a spanning forest stays, so components
    are exact and no group gives all its pairs. A cell of over ``tile`` nodes is cut into tiles, and
    each pair of tiles is a group of its own. What is alone in its cell goes, and rows of cells of very many nodes are not sent to learn how many.
    """
    cells = durable(cells)
    sized = durable(cells.groupBy("choice", "at").agg(F.count("*").alias("n"), F.count("*").alias("held")).where("n > 1"))
    cells = with_fact(cells, sized, ["choice", "at"], "n")
    tiles = F.ceil(F.col("held") / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
    names = ["node"] if words is None else [c for c in words.columns if c != "node"]
    if words is not None:
        cells = cells.join(words, "node")
    dealt = cells.select("choice", "at", "node", *([] if words is None else names), own.alias("own"), F.explode(pairs).alias("pair"))
    dealt = dealt.select("choice", "at", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "own", "node", *([] if words is None else names))
    key = ["choice", "at", "i", "j"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: pa.Table) -> pa.RecordBatch:
            keys = np.stack([part.column(c).to_numpy().astype(np.int64) for c in key], axis=1)
            own, node = part.column("own").to_numpy(), part.column("node").to_numpy()
            bits = np.stack([part.column(c).to_numpy().view(np.uint64) for c in names], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            out: list[np.ndarray] = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
                i, j = keys[s, 2:]
                if e - s < 2:
                    continue
                if e - s == 2:
                    if int(np.bitwise_count(bits[s] ^ bits[s + 1]).sum()) <= reach:
                        out.append(node[s : s + 2])
                    continue
                order = np.argsort(own[s:e] != i, kind="stable") + s
                cut = int((own[s:e] == i).sum())
                pairs = _forest(bits[order], None, reach) if i == j else _forest(bits[order[:cut]], bits[order[cut:]], reach)
                out += [node[order[list(x)]] for x in pairs]
            found = np.array(out, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            table = pa.Table.from_batches(held)
            same = np.ones(table.num_rows, dtype=bool)  # rows of the last group, which may go on in the next batch
            for c in key:
                column = table.column(c).to_numpy()
                same &= column == column[-1]
            n = int(np.argmax(same))
            if n:
                yield done(table.slice(0, n))
            held = table.slice(n).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, n: int = 3, reach: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    Null, empty and wordless texts have fingerprint zero and link like any other. component_id is the
    smallest non-null doc_id reachable by links of at most ``reach`` differing bits (null if all
    reachable are null). Repeated rows are one group. No rows: no rows. Other columns are not looked at.
    """
    fps = durable(fingerprints(docs, n, seed))
    owners = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")))
    groups = least_reachable(components(links(_cells(owners, reach), reach)), owners.select(F.col("fp").alias("node"), "owner"))
    known = durable(owners.join(groups, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("least", "owner").alias("component_id"), "n"))
    return with_fact(fps, known, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of the wide fingerprint, samples of each long text, and shingles of a sample, in the similarity search.
WORDS, SAMPLES, SAMPLE = 8, 12, 2
#: Texts of fewer distinct shingles meet by their own lowest shingles, not by samples.
SHORT = 40
#: Most texts, and about the most shingles, of one tile of a candidate group.
GROUP_TILE, SHINGLE_TILE = 8192, 1 << 19


def prefix_length(size: int, similarity: float) -> int:
    """So many lowest shingles of each of two texts have one in common, if they are that similar."""
    return size - math.ceil(size * similarity - 1e-9) + 1


def sketch(hashes: np.ndarray, similarity: float = 0.8) -> tuple[np.ndarray, list[int], list[int]]:
    """Of a text's distinct shingles: a wide SimHash, the lowest shingles of a short text, and samples of a long one.

    A sample is the SAMPLE shingles that are lowest under one of SAMPLES orders, so texts that share
    a part J of their shingles have an equal sample with chance near J**SAMPLE. Texts that a short one
    can be similar to have lowest shingles too.
    """
    h = hashes
    if not len(h):
        return np.zeros(WORDS, dtype=np.uint64), [], []
    many = SAMPLES if len(h) >= SHORT else 0
    orders = [mix64(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(1, max(WORDS, many) + 1)]
    wide = np.array([_majority(x) for x in orders[:WORDS]], dtype=np.uint64)
    lowest = np.sort(orders[0])[: prefix_length(len(h), similarity)] if len(h) * similarity < SHORT else h[:0]
    lows = [np.sort(np.partition(x, SAMPLE - 1)[:SAMPLE]) for x in orders[:many]]
    samples = [int(mix64(np.bitwise_xor.reduce(mix64(low) * np.arange(1, 2 * SAMPLE, 2, dtype=np.uint64), keepdims=True))[0]) for low in lows]
    return wide, lowest.view(np.int64).tolist(), np.array(samples, dtype=np.uint64).view(np.int64).tolist()


@functools.cache
def differing_bits(similarity: float, short: bool, bits: int = 64 * WORDS, sigmas: float = 5.0) -> int:
    """Bits of ``bits`` in which fingerprints of texts with at least that Jaccard similarity differ at most, but
    for one case in a million: in long texts each bit differs with chance acos(2J / (1 + J)) / pi; in those of few
    shingles, where ties count, with that of the worst sizes."""
    worst = math.acos(2 * similarity / (1 + similarity)) / math.pi
    tail = functools.cache(lambda n: np.cumsum([math.comb(n, k) / 2**n for k in range(n, -1, -1)])[::-1])

    def over(both: int, own: int) -> np.ndarray:
        """For each number of set bits among the common shingles, the chance that over half of all are set."""
        need = (both + own) // 2 + 1 - np.arange(both + 1)
        return np.where(need > own, 0.0, tail(own)[np.clip(need, 0, own)])

    least, most = (1, SHORT) if short else (math.floor(SHORT * similarity), 2 * SHORT)
    for both in range(least, most + 1):
        chance = -np.diff(np.r_[tail(both), 0.0])
        others = math.floor(both / similarity - both + 1e-9)
        for x in range(others + 1):
            for y in range(min(x, others - x) + 1):
                u, v = over(both, x), over(both, y)
                worst = max(worst, float((chance * (u * (1 - v) + v * (1 - u))).sum()))
    return math.floor(bits * worst + sigmas * math.sqrt(bits * worst * (1 - worst)))


def exact_links(sets: list[np.ndarray], wide: np.ndarray, cut: int | None, similarity: float) -> list[tuple[int, int]]:
    """Links of Jaccard similarity at least ``similarity``, counted on sets of distinct shingles and thinned to a
    spanning forest: among all sets, or (``cut`` given) between the first ``cut`` and the others.

    Only pairs of fitting sizes and near fingerprints are counted, and none that is linked by others already.
    """
    size = np.array([len(x) for x in sets], dtype=np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.empty(0, dtype=np.int64)
    mark = np.zeros(len(ids), dtype=bool)
    thin = Thinner(len(sets))
    reach = np.array([differing_bits(similarity, False), differing_bits(similarity, True)])
    for k in range(len(sets) if cut is None else cut):
        first = k + 1 if cut is None else cut
        j = np.flatnonzero(thin.group[first:] != thin.group[k]) + first
        j = j[np.minimum(size[j], size[k]) >= similarity * np.maximum(size[j], size[k]) - 1e-9]
        j = j[np.bitwise_count(wide[j] ^ wide[k]).sum(axis=1, dtype=np.int64) <= reach[(np.minimum(size[j], size[k]) < SHORT).astype(np.int64)]]
        if not len(j):
            continue
        mark[ids[starts[k] : ends[k]]] = True
        stops = np.cumsum(size[j])
        at = np.arange(stops[-1]) + np.repeat(starts[j] - (stops - size[j]), size[j])
        common = np.add.reduceat(mark[ids[at]].astype(np.int64), stops - size[j])
        mark[ids[starts[k] : ends[k]]] = False
        hit = common >= similarity * (size[k] + size[j] - common) - 1e-9
        if hit.any():
            thin.add(k, j[hit])
    return thin.links


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return tuple(np.array([both >> 64, both & (1 << 64) - 1], dtype=np.uint64).view(np.int64).tolist())


def counted_links(docs: DataFrame, nodes: DataFrame, near: DataFrame, n: int, similarity: float, seed: int) -> DataFrame:
    """Links ``(a, b)`` of texts of one group of ``near(node, component)`` of which shingles were compared.

    Shingles are made again for the texts of such groups, and sent once to each tile pair of the group:
    a group of many texts or shingles is cut into tiles.
    """
    chosen = durable(near.join(nodes, "node"))
    owners = chosen.select(F.col("owner.doc_id").alias("near_owner")).distinct()
    may, _ = sift(docs.select("doc_id", "text"), [F.col("doc_id")], durable(owners))
    texts = may.join(owners, F.col("doc_id").eqNullSafe(F.col("near_owner")), "left_semi")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                sets = [np.unique(shingle_hashes(t.as_py(), n, seed)) for t in b.column("text").slice(at, 500)]
                keys = np.array([_digest(x) for x in sets], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([x.tobytes() for x in sets], pa.binary())], names=["h1", "h2", "shingles"])

    made = texts.mapInArrow(shingles, "h1 bigint, h2 bigint, shingles binary").groupBy("h1", "h2").agg(F.first("shingles").alias("shingles"))
    sized = durable(chosen.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / GROUP_TILE), F.ceil(F.sum("size") / SHINGLE_TILE)).cast("int").alias("tiles"), F.count("*").alias("n")))
    w = [f"w{k}" for k in range(WORDS)]
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
    rows = with_fact(chosen.select("node", "component", "h1", "h2", *w), sized, ["component"], "n").join(made, ["h1", "h2"])
    dealt = rows.select("component", "node", *w, "shingles", own.alias("own"), F.explode(pairs).alias("pair"))
    dealt = dealt.select("component", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "own", "node", *w, "shingles")

    def run(key: tuple, part: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        node, own = part.column("node").to_numpy(), part.column("own").to_numpy()
        order = np.argsort(own != i, kind="stable")
        wide = np.stack([part.column(c).to_numpy().view(np.uint64) for c in w], axis=1)[order]
        column = part.column("shingles")
        sets = [np.frombuffer(column[k].as_buffer(), dtype=np.uint64) for k in order.tolist()]
        found = exact_links(sets, wide, None if i == j else int((own == i).sum()), similarity)
        ends = node[order[np.array(found, dtype=np.int64).reshape(-1, 2)]]
        return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})

    return dealt.groupBy("component", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _grouped(docs: DataFrame, n: int, similarity: float, seed: int) -> DataFrame:
    """``(doc_id, t1, t2, first)``: each row, its text's hashes, and the first row of its group as a struct of none (it
    has no id), doc_id, t1 and t2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            sets = [np.unique(shingle_hashes(t.as_py(), n, seed)) for t in b.column("text")]
            made = [sketch(x, similarity) for x in sets]
            keys = np.array([_digest(x) for x in sets], dtype=np.int64).reshape(-1, 2)
            wide = np.array([x[0] for x in made], dtype=np.uint64).reshape(-1, WORDS).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(x[:, k])) for x in (keys, wide) for k in range(x.shape[1])]
            cells = [pa.array([x[k] for x in made], pa.list_(pa.int64())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], pa.array([len(x) for x in sets], pa.int64()), *columns, *cells], names=[*own, "size", "h1", "h2", *w, "lowest", "samples"])

    w, own = [f"w{k}" for k in range(WORDS)], ["doc_id", "t1", "t2"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in ["t1", "t2", "size", "h1", "h2", *w]) + ", lowest array<bigint>, samples array<bigint>"
    t1, t2 = text_key(F.col("text"))
    made = durable(docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), "text").mapInArrow(run, schema))
    row = F.struct(F.col("doc_id").isNull().alias("none"), *own)
    nodes = made.groupBy("h1", "h2").agg(F.min(row).alias("owner"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", *w, "lowest", "samples")])
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    short = nodes.select("node", F.lit(-1).cast("tinyint").alias("choice"), F.explode("lowest").alias("fp"))
    long = nodes.select("node", F.posexplode("samples").alias("choice", "fp")).withColumn("choice", F.col("choice").cast("tinyint"))
    near = [links(c.select("node", "choice", _counts("fp").alias("at")).distinct(), differing_bits(similarity, k), nodes.select("node", *w), tile=2048) for c, k in ((short, True), (long, False))]
    groups = components(near[0].union(near[1]))
    alike = components(counted_links(docs, nodes.drop("lowest", "samples"), groups, n, similarity, seed))
    known = nodes.join(least_reachable(alike, nodes.select("node", "owner")), "node", "left")
    known = durable(known.select("h1", "h2", F.coalesce("least", "owner").alias("first"), "n"))
    return with_fact(made.select(*own, "h1", "h2"), known, ["h1", "h2"], "n").select(*own, "first")


def similar_groups(docs: DataFrame, n: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """``(doc_id, component_id)`` of documents that links of a Jaccard similarity of at least ``similarity`` join,
    counted on the hashes of their distinct word shingles.

    Plain 64-bit fingerprints of such texts differ in ten bits, too many for grid cells to hold them
    together. So cells are popcount vectors of hashes of small samples, several per text (of short texts, of
    their lowest shingles, of which any two similar texts share one). What shares a cell is compared by its wide
    fingerprint, Manhattan bound and then bits, within five deviations; what is near in that is a candidate,
    and candidates are linked only if their shingles, counted, are similar enough.
    Null, empty and wordless texts are one group; component_id is the smallest doc_id of a group.
    """
    return _grouped(docs, n, similarity, seed).select("doc_id", F.col("first.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each group, the first by doc_id and then by its text's hash; columns stay, whatever their names.

    Rows are told apart by doc_id and text: one that repeats another's doc_id goes only for its own text, and of rows
    that repeat both one is left. Texts without words are one group. A null doc_id is the last of its group. No rows: no rows.
    """
    rows, _ = split_copies(packed(docs))
    found = _grouped(docs.select("doc_id", "text"), n, similarity, seed)
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2")))
    gone = durable(found.where(other).select(*[F.xxhash64(F.lit(k), F.col("doc_id").isNull(), "doc_id", "t1", "t2").alias(f"k{k}") for k in (0, 1)]).distinct())
    keys = row_keys()
    may, others = sift(rows, keys, gone)
    left = may.select("row", *[k.alias(f"k{i}") for i, k in enumerate(keys)]).join(gone, ["k0", "k1"], "left_anti").select("row").union(others)
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
