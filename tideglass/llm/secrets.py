"""Secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, with_fact
from .spans import all_matches, cut_at, joined, overlaps, placed, with_blocks

KINDS = ("assign", "access", "hex", "token")
_KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Expressions of the kinds; the first three are the base, the last is the method's own candidate.
PATTERNS = {
    "assign": _KEY + r"[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"[0-9a-f]{16,}+",
    "token": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}


def _valid(kind: str, m: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_replace(m, "^" + _KEY, "")) >= 12
    if kind == "access":
        return F.length(m) >= 18
    if kind == "token":
        return m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    return F.lit(True)


def candidates(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, owner, t1, t2, found)``: all candidate spans of each text with a hash pair of the value.

    ``found`` has kind (number), start, end, h1, h2; t1 and t2 are hashes of the text. Needs doc_id, text and ``owner``; null text has none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = text.rlike("(?i:password|passwd|secret|token|api_?key)")
    possible = {"assign": key, "access": text.contains("AKIA"), "hex": None, "token": None}
    rows = docs.select("doc_id", "owner", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    rows = rows.select("*", *[all_matches(F.col("text"), PATTERNS[k], possible[k]).alias(f"m_{k}") for k in KINDS])
    rows = rows.select("doc_id", "owner", "t1", "t2", *[cut_at(F.col("text"), F.col(f"m_{k}"), PATTERNS[k]).alias(k) for k in KINDS])
    rows = rows.select("doc_id", "owner", "t1", "t2", *[placed(k).alias(k) for k in KINDS])

    def spans(number: int, kind: str) -> Column:
        value = (lambda m: F.regexp_replace(m, "^" + _KEY, "")) if kind == "assign" else (lambda m: m)
        kept = F.filter(kind, lambda s: _valid(kind, s["m"]))
        return F.transform(kept, lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(value(s["m"])).alias("h1"), F.xxhash64(F.lit(1), value(s["m"])).alias("h2")))

    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "t1", "t2", F.concat(*[spans(k, kind) for k, kind in enumerate(KINDS)]).alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """``(h1, h2, repositories, owners, n)``: distinct documents and owners of each candidate value, and its places.

    Documents of equal text are copies of one and count once. Both counts are made in steps, so that a
    value that very many documents have is not one task. A null owner counts as one.
    """
    each = found.select("t1", "t2", F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"), F.inline("found"))
    return each.groupBy("h1", "h2").agg(F.countDistinct("t1", "t2").alias("repositories"), F.countDistinct("owner").alias("owners"), F.count("*").alias("n"))


def scan(docs: DataFrame, most_owners: int = 2, most_repositories: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``row``, doc_id, base (spans), spans (all, each with the ``repositories`` and ``owners`` that have its
    value), live, copied (numbers of values).

    A value that over ``most_owners`` owners have, or over ``most_repositories`` documents of different
    texts, is a copied example; others look live. All base spans
    stay whatever they are; ``token`` spans are added where the value looks live and no base span overlaps.
    """
    found = durable(candidates(docs))
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    freq = durable(ownership(found).select("h1", "h2", "n", live.alias("live"), "repositories", "owners"))
    each = with_fact(found.select("row", F.inline("found")), freq, ["h1", "h2"], "n")
    judged = each.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "live", "repositories", "owners")).alias("judged"))
    rows = found.select("row", "doc_id").join(judged, "row", "left")
    rows = rows.withColumn("judged", F.coalesce("judged", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,repositories:bigint,owners:bigint>>")))
    rows = with_blocks(rows.withColumn("base", F.filter("judged", lambda s: s["kind"] < 3)), "base", "blocks")
    added = F.filter("judged", lambda s: (s["kind"] == 3) & s["live"] & ~overlaps("blocks", s))
    rows = rows.withColumn("spans", F.concat("base", added))
    return rows.select("row", "doc_id", "base", "spans", F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("copied"))


def secrets_report(docs: DataFrame, most_owners: int = 2, most_repositories: int = 10) -> DataFrame:
    """Digest of :func:`scan`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, and of its values the most
    repositories and owners that one has (0: it has none).

    Documents stand for repositories, their ``source`` for the owner. Null text is empty and has no spans.
    Repeated rows give a row each; no rows, none. Other columns are not looked at.
    """
    found = scan(docs.select("doc_id", "text", F.col("source").alias("owner")), most_owners, most_repositories)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"), F.col("live").alias("n_live"), F.col("copied").alias("n_copied"), *[F.coalesce(F.array_max(F.transform("spans", lambda s: s[c])), F.lit(0).cast("long")).alias(f"most_{c}") for c in ("repositories", "owners")])
