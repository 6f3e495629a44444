"""Prefix trie of rebuilt conversations by fingerprints that compose.

A turn is an element (1, x) of a monoid, a run of turns the product of its turns: (n, v) (m, w) = (n + m, v + B^n w),
in four lanes modulo the prime 2^31 - 1. Products of prefixes of the stored conversations are computed once; a rebuilt
conversation's prefixes are products of a base's head and the conversation's own later turns, put together from
those numbers. No rebuilt text exists anywhere.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, sift, with_fact
from .mixing import words

PRIME = (1 << 31) - 1
LANES = 4
#: Longest head that is taken from a base.
LONGEST_HEAD = 3
#: Range of ids whose decimal forms are joined as one piece of a node's list of ends.
PIECE = 512


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % 20


def head_of(conv_id: Column) -> Column:
    """Turns that are taken from the base, at most LONGEST_HEAD."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def multipliers(seed: int, prime: int = PRIME) -> list[Powers]:
    return [Powers(random.Random(f"{seed} {k}").randrange(2, prime), prime) for k in range(LANES)]


class Powers:
    """Powers of a multiplier, six bits of the exponent (0 to 2^36) at a time; below zero down to -LONGEST_HEAD."""

    def __init__(self, base: int, prime: int):
        numbers = lambda xs: F.expr(f"array({', '.join(f'{x}L' for x in xs)})")
        self.prime = prime
        self.tables = [numbers(pow(base, x << (6 * k), prime) for x in range(64)) for k in range(6)]
        self.inverse = numbers(pow(pow(base, -1, prime), x, prime) for x in range(LONGEST_HEAD + 1))

    def up(self, n: Column) -> Column:
        out = F.get(self.tables[0], n.bitwiseAND(63).cast("int"))
        for k, table in enumerate(self.tables[1:], 1):
            out = out * F.get(table, F.shiftright(n, 6 * k).bitwiseAND(63).cast("int")) % self.prime
        return out

    def down(self, n: Column) -> Column:
        return F.get(self.inverse, n.cast("int"))


def _lanes(h1: str, h2: str, prime: int) -> list[Column]:
    """Four numbers below ``prime`` of a turn's two hashes."""
    return [x % prime for h in (h1, h2) for x in (F.col(h).bitwiseAND((1 << 31) - 1), F.shiftrightunsigned(h, 33))]


def stored_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """``(conv_id, turn, role, text, h1, h2, words)``: turns with two hashes of role and text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), words(text).alias("words"))
    return rows.withColumn("h1", F.xxhash64(F.lit(seed), "role", "text")).withColumn("h2", F.xxhash64(F.lit(~seed), "text", "role"))


def own_prefixes(turns: DataFrame, base: list[Powers], prime: int = PRIME) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, pos, h1, h2, words, v0 ..)``, the product of the first ``pos`` turns of each stored conversation, and
    ``(conv_id, n_own)``.

    Turns go by ``turn`` (null first), equal ones by their hashes. They are dealt by range, so that a conversation
    of very many turns is spread over partitions: each takes the products of its own stretch, and the stretches'
    products, one row each, are composed in order.
    """
    order = ["turn", "h1", "h2"]
    dealt = durable(turns.select("conv_id", *order, "words").repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    w = W.partitionBy("part", "conv_id").orderBy(*order)
    x = dealt.withColumn("i", F.row_number().over(w).cast("long"))
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    terms = [(F.sum(v * b.up(F.col("i")) % prime).over(so_far) % prime).alias(f"v{k}") for k, (v, b) in enumerate(zip(_lanes("h1", "h2", prime), base, strict=True))]
    local = durable(x.select("part", "conv_id", "i", "h1", "h2", "words", *terms))
    vs = [f"v{k}" for k in range(LANES)]
    stretch = local.groupBy("part", "conv_id").agg(F.max("i").alias("n"), F.max_by(F.struct(*vs), "i").alias("v"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    stretch = stretch.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    placed = [(F.sum(F.col("v")[v] * b.up(F.col("at")) % prime).over(before) % prime).alias(f"b{k}") for k, (v, b) in enumerate(zip(vs, base, strict=True))]
    stretch = durable(stretch.select("part", "conv_id", "n", "at", *placed))
    # a stretch with turns before it is the first one of its partition: as many rows as partitions at most
    later = stretch.where("at > 0").select("part", "conv_id", "at", *[f"b{k}" for k in range(LANES)])
    own = local.join(F.broadcast(later), ["part", "conv_id"], "left").withColumn("at", F.coalesce("at", F.lit(0).cast("long")))
    values = [((F.coalesce(f"b{k}", F.lit(0).cast("long")) + F.col(f"v{k}") * b.up(F.col("at"))) % prime).alias(f"v{k}") for k, b in enumerate(base)]
    own = durable(own.select("conv_id", (F.col("at") + F.col("i")).alias("pos"), "h1", "h2", "words", *values))
    return own, stretch.groupBy("conv_id").agg(F.sum("n").alias("n_own"))


def rebuilt_prefixes(own: DataFrame, sizes: DataFrame, multiplier: list[Powers], prime: int = PRIME, base: Callable = base_of, head: Callable = head_of) -> DataFrame:
    """``(conv_id, depth, f1, f2, p1, p2, h1, h2, words, ends)``, one row per prefix of each rebuilt conversation, the
    empty one too: its fingerprint, that of the prefix before, hashes and words of its last turn, and whether the
    conversation ends there."""
    vs = [f"v{k}" for k in range(LANES)]
    turn = F.struct("pos", "h1", "h2", "words", *vs)
    heads = own.where((F.col("pos") <= LONGEST_HEAD) & (base(F.col("conv_id")) == F.col("conv_id"))).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("heads"))
    cut = own.where(F.col("pos") == head(F.col("conv_id"))).select("conv_id", F.struct(*vs).alias("skip"))
    convs = sizes.select("conv_id", "n_own", base(F.col("conv_id")).alias("base"), head(F.col("conv_id")).cast("long").alias("h")).join(cut, "conv_id", "left").join(heads, "base", "left")
    taken = F.slice(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), F.lit(1), F.col("h").cast("int"))
    convs = convs.withColumn("heads", taken).withColumn("k", F.size("heads").cast("long"))
    convs = durable(convs.withColumn("depths", F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0).cast("long"))))
    zero = F.lit(0).cast("long")
    whole = [F.coalesce(F.get("heads", (F.col("k") - 1).cast("int"))[v], zero) for v in vs]
    facts = convs.select("conv_id", "n_own", "h", "k", "depths", *[w.alias(f"w{j}") for j, w in enumerate(whole)], *[F.coalesce(F.col("skip")[v], zero).alias(f"s{j}") for j, v in enumerate(vs)])
    later = with_fact(own, facts.withColumn("n", F.col("n_own")), ["conv_id"], "n").where("pos > h")
    back = [b.down(F.col("h") - F.col("k")) for b in multiplier]
    moved = [((F.col(f"w{j}") + F.pmod(F.col(v) - F.col(f"s{j}"), F.lit(prime)) * back[j]) % prime).alias(v) for j, v in enumerate(vs)]
    later = later.select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "depths", "h1", "h2", "words", *moved)
    first = convs.select("conv_id", "depths", F.explode("heads").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "depths", *[F.col(f"t.{c}") for c in ("h1", "h2", "words", *vs)])
    rows = first.unionByName(later)
    last = [F.pmod(F.col(v) - x * b.up(F.col("depth")) % prime, F.lit(prime)) for v, x, b in zip(vs, _lanes("h1", "h2", prime), multiplier, strict=True)]
    pack = lambda x: [x[0] * (1 << 31) + x[1], x[2] * (1 << 31) + x[3]]
    f, p = pack([F.col(v) for v in vs]), pack(last)
    rows = rows.select("conv_id", "depth", f[0].alias("f1"), f[1].alias("f2"), p[0].alias("p1"), p[1].alias("p2"), "h1", "h2", "words", (F.col("depth") == F.col("depths")).alias("ends"))
    none = F.lit(None).cast("long")
    return rows.union(convs.select("conv_id", zero, zero, zero, none, none, none, none, zero, F.col("depths") == 0))


def same_contents(turns: DataFrame) -> bool:
    """Whether turns of equal hashes have one role and text. Only turns whose hashes come twice are compared, by the
    least and the greatest of them, so a turn that very many conversations have is no single task."""
    twice = durable(turns.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    may, _ = sift(turns.select("h1", "h2", "role", "text"), [F.col("h1"), F.col("h2")], twice)
    turn = F.struct("role", "text")
    return may.groupBy("h1", "h2").agg(F.min(turn).alias("a"), F.max(turn).alias("b")).where("a <> b").isEmpty()


def running_before(rows: DataFrame, by: str, order: str, values: list[str]) -> DataFrame:
    """``rows`` with the sums of ``values`` over earlier rows of ``by`` by ``order`` as ``before_*``. Rows are dealt by
    range, so one of ``by`` with very many rows is spread over partitions, whose sums are added up in order."""
    dealt = durable(rows.repartitionByRange(by, order).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part", by).agg(*[F.sum(v).alias(v) for v in values])
    past = W.partitionBy(by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    later = durable(sums.select("part", by, *[F.sum(v).over(past).alias(f"past_{v}") for v in values]).where(f"past_{values[0]} is not null"))
    own = W.partitionBy("part", by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    x = dealt.join(F.broadcast(later), ["part", by], "left")
    return x.select(*rows.columns, *[(F.coalesce(F.sum(v).over(own), zero) + F.coalesce(f"past_{v}", zero)).alias(f"before_{v}") for v in values])


def ends_hashes(rows: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, ends_sha256)`` of ``rows(*key, conv_id)``: SHA-256 of each key's ids, ascending, comma-joined.

    Ids are joined in pieces of ranges of PIECE ids. The hash itself takes the pieces of a key in order, one after the other
    in one task, as SHA-256 is defined, and holds one batch of them at a time.
    """
    piece = F.floor(F.col("conv_id") / PIECE)
    pieces = rows.groupBy(*key, piece.alias("piece")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for b in batches:
            out = []
            for *own, ids in zip(*[b.column(c).to_pylist() for c in (*key, "ids")], strict=True):
                if own == held:
                    digest.update(b"," + ids.encode())
                else:
                    if held is not None:
                        out.append((*held, digest.hexdigest()))
                    held, digest = own, hashlib.sha256(ids.encode())
            yield batch(out)
        if held is not None:
            yield batch([(*held, digest.hexdigest())])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * (len(key) + 1)
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.string())], names=[*key, "ends_sha256"])

    ordered = pieces.repartition(*key).sortWithinPartitions(*key, "piece").select(*key, "ids")
    return ordered.mapInArrow(run, ", ".join(f"{c} bigint" for c in key) + ", ends_sha256 string")


def prefix_trie(conversations: DataFrame, base: Callable = base_of, head: Callable = head_of, prime: int = PRIME) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: the nodes of the
    prefixes of all rebuilt conversations, each named by its smallest conversation and its depth.

    A conversation is rebuilt from the first turns of its base (as many as ``head`` tells, or all it has; none if there
    is no base) and its own turns after as many. ``head`` may be 3 at most. Turns go by ``turn``, null first, equal ones
    by hashes of role and text, so results don't depend on the order of rows. Null role or text counts as empty, rows
    without conv_id as no conversation; repeated rows are turns of their own. A remainder has its number's sign, as in SQL.
    No conversations: no rows. Extra columns are not read.

    Prefixes with equal fingerprints are one node, and that is checked: all its rows must have the same prefix
    before and the same hashes of the last turn, and turns of equal hashes the same role and text. So by
    induction nodes are exactly the distinct prefixes. If a check fails, all is done again with other multipliers.

    A node's subtree is summed without walking the tree: each node belongs to its smallest conversation, whose nodes are
    then the last stretch of its path. The subtree of a node is all that its other members own, and what
    its smallest member owns from its depth on: one sum over members, less one running sum.
    """
    key = ["depth", "f1", "f2"]
    for seed in count():
        turns = stored_turns(conversations, seed)
        by = multipliers(seed, prime)
        own, sizes = own_prefixes(turns, by, prime)
        rows = durable(rebuilt_prefixes(own, sizes, by, prime, base, head))
        seen = F.struct("p1", "p2", "h1", "h2")
        nodes = durable(rows.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least"), F.min("words").alias("words"), F.min(seen).alias("lo"), F.max(seen).alias("hi")))
        if nodes.where("not lo <=> hi").isEmpty() and same_contents(turns):
            break
    nodes = nodes.select(*key, "n_convs", "least", "words", F.col("lo.p1").alias("p1"), F.col("lo.p2").alias("p2"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")]
    children = nodes.where("depth > 0").select(*up).groupBy(*key).agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    nodes = durable(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    parents = nodes.where("n_children > 0").select(*key, F.col("least").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = nodes.where("depth > 0").select(*up, F.col("depth").alias("own"), F.col("f1").alias("own1"), F.col("f2").alias("own2"))
    parent_of = with_fact(below, parents, key, "n").select(F.col("own").alias("depth"), F.col("own1").alias("f1"), F.col("own2").alias("f2"), "parent_conv_id")
    owned = nodes.select(*key, "least", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"))
    own = running_before(owned, "least", "depth", ["saved", "leaf"])
    of_conv = owned.groupBy(F.col("least").alias("conv_id")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    of_conv = durable(of_conv.join(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id"))
    members = with_fact(rows.select("conv_id", *key), of_conv, ["conv_id"], "n").groupBy(*key).agg(F.sum("saved").alias("all_saved"), F.sum("leaf").alias("all_leaf"))
    subtree = own.join(members, key).select(*key, (F.col("all_leaf") - F.col("before_leaf")).alias("n_leaves"), (F.col("all_saved") - F.col("before_saved")).alias("saved_tokens"))
    ends = ends_hashes(rows.where("ends").select(*key, "conv_id"), key)
    found = nodes.join(subtree, key).join(parent_of, key, "left").join(ends, key, "left")
    return found.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
