"""Personal data by weak supervision: labellers vote on spans, expectation-maximisation weighs them, and a
span classifier decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .spans import all_matches, cut_at, digits, joined, luhn, overlaps, placed, with_blocks

KINDS = ("email", "ip", "card", "phone")
#: The base expressions. A run of characters is only tried from its first one or from
#: where the last match ended, as no later one can match; so long runs cost no square.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates that the base does not have: written-out addresses, and national phone numbers.
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+(\x20-])\x20?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: Gazetteers. Endings of addresses, starts of card numbers, country codes.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "co", "us", "ch", "at", "it", "nl")
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
COUNTRY_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])(?![0-9]{12})"
#: Words that stand before such data, and before numbers that are something else.
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|address|from|cc|send)\W*$",
    "ip": r"(?i)(?:ip|host|server|address|from|client|login)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|pay|paid)\W*(?:no|number|num)?\W*$",
    "phone": r"(?i)(?:call|phone|tel|mobile|cell|fax|contact|ring)\W*$",
}
OTHER_CUES = r"(?i)(?:order|invoice|version|ver|isbn|issn|doi|item|ref|serial|release|build|section|no|nr|id|v)\W*$"
LABELLERS = ("format", "check", "gazetteer", "context", "edges")


def _valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return n.between(14, 19) & F.when(n <= 19, luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    """1 for, 2 against, 0 abstains."""
    return F.when(yes, 1).when(no, 2).otherwise(0)


def _votes(kind: str, loose: bool, s: Column) -> Column:
    """The labellers' votes as a number in base 3, the first lowest."""
    m, n = s["m"], F.length(digits(s["m"]))
    ending = F.lower(F.regexp_extract(F.right(m, F.lit(16)), r"([A-Za-z0-9-]+)$", 1)).isin(*ENDINGS)
    fmt = {"email": F.lit(2 if loose else 1), "ip": _vote(F.length(m) <= 15, F.length(m) > 15), "card": _vote(n.isin(15, 16), (n < 14) | (n > 19)), "phone": F.lit(0 if loose else 1)}[kind]
    check = {"email": _vote(m.rlike(r"^[A-Za-z0-9].*[A-Za-z]$"), F.length(m) > 254), "ip": _vote(_valid(kind, m), ~_valid(kind, m)), "card": _vote(_valid(kind, m), ~_valid(kind, m)), "phone": _vote(n.between(10, 13), ~n.between(8, 15))}[kind]
    listed = {"email": _vote(ending, ~ending), "ip": _vote(~m.rlike(r"^(?:0|255|127)\."), m.rlike(r"^0+\.")), "card": _vote(digits(m).rlike(CARD_STARTS), ~digits(m).rlike(CARD_STARTS)), "phone": _vote(m.rlike(COUNTRY_CODES), m.rlike(r"^\+0"))}[kind]
    context = _vote(s["before"].rlike(CUES[kind]), s["before"].rlike(OTHER_CUES))
    clear = ~s["before"].rlike(r"[A-Za-z0-9._/-]$") & ~s["after"].rlike(r"[A-Za-z0-9_/]")
    edges = _vote(clear, ~clear)
    total = F.lit(0)
    for k, v in enumerate((fmt, check, listed, context, edges)):
        total = total + v * 3**k
    return total.cast("int")


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, found)``: every candidate of each text with kind (number), start, end, base (it is a base span), votes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    number, at = text.rlike("[0-9]"), text.contains("@")
    possible = {"email": at, "ip": number, "card": number, "phone": text.contains("+")}
    written = text.rlike(r"(?:\(dot\)|\[dot\]|\x20dot\x20)")
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("*", *[all_matches(F.col("text"), BASE[k], possible[k]).alias(f"m_{k}") for k in KINDS], *[all_matches(F.col("text"), LOOSE[k], {"email": written, "phone": number}[k]).alias(f"l_{k}") for k in LOOSE])
    rows = rows.select("doc_id", *[cut_at(F.col("text"), F.col(f"m_{k}"), BASE[k]).alias(k) for k in KINDS], *[cut_at(F.col("text"), F.col(f"l_{k}"), LOOSE[k]).alias(f"l_{k}") for k in LOOSE])
    rows = rows.select("doc_id", *[placed(c).alias(c) for c in rows.columns[1:]])
    def spans(column: str, kind: str) -> Column:
        loose = column != kind

        def one(s: Column) -> Column:
            lead = F.length(s["m"]) - F.length(F.ltrim(s["m"])) if loose else F.lit(0)
            base = F.lit(False) if loose else _valid(kind, s["m"])
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), (s["start"] + lead).alias("start"), s["end"].alias("end"), base.alias("base"), _votes(kind, loose, s).alias("votes"))

        long_enough = F.filter(column, lambda s: F.length(digits(s["m"])) >= 13) if kind == "card" else F.col(column)
        return F.transform(long_enough, one)

    lists = [spans(k, k) for k in KINDS] + [spans(f"l_{k}", k) for k in LOOSE]
    return rows.select("doc_id", F.concat(*lists).alias("found"))


def reliabilities(rows: list[tuple[int, int, float]], rounds: int = 100) -> tuple[dict[tuple[int, int], float], dict[tuple[int, int], float]]:
    """Expectation-maximisation over ``(kind, votes, count)``.

    Per kind two classes; a labeller that votes is right with its own chance in each class, abstaining
    tells nothing. Starts from the majority. Gives the chance of being personal data for each (kind, votes), and
    each (kind, labeller)'s part of right votes. Sizes are bounded by kinds and vote patterns, not by data.
    """
    posterior: dict[tuple[int, int], float] = {}
    right: dict[tuple[int, int], float] = {}
    for kind in sorted({r[0] for r in rows}):
        own = [([votes // 3**k % 3 for k in range(len(LABELLERS))], n, votes) for k_, votes, n in rows if k_ == kind]
        p = [(v.count(1) + 1.0) / (v.count(1) + v.count(2) + 1.5) for v, _, _ in own]
        for _ in range(rounds):
            whole = sum(n for _, n, _ in own)
            prior = (sum(x * n for x, (_, n, _) in zip(p, own, strict=True)) + 2) / (whole + 3)
            chance = []
            for k in range(len(LABELLERS)):
                hit = [8.0, 2.0]
                said = [10.0, 10.0]
                for x, (v, n, _) in zip(p, own, strict=True):
                    if v[k]:
                        said[0] += x * n
                        said[1] += (1 - x) * n
                        hit[0] += x * n * (v[k] == 1)
                        hit[1] += (1 - x) * n * (v[k] == 1)
                chance.append((hit[0] / said[0], hit[1] / said[1]))
            new = []
            for v, _, _ in own:
                z = math.log(prior / (1 - prior))
                for k, x in enumerate(v):
                    a, b = chance[k]
                    z += math.log(a / b) if x == 1 else math.log((1 - a) / (1 - b)) if x == 2 else 0.0
                new.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
            moved = max(abs(x - y) for x, y in zip(p, new, strict=True))
            p = new
            if moved < 1e-9:
                break
        for x, (v, _, votes) in zip(p, own, strict=True):
            posterior[kind, votes] = x
        for k in range(len(LABELLERS)):
            said_n = sum(n for v, n, _ in own if v[k])
            right[kind, k] = sum(n * (x if v[k] == 1 else 1 - x) for x, (v, n, _) in zip(p, own, strict=True) if v[k]) / said_n if said_n else 0.5
    return posterior, right


def train(rows: list[tuple[int, int, float]], posterior: dict[tuple[int, int], float], rounds: int = 400) -> list[list[float]]:
    """Logistic regression on the posteriors: per kind a bias and a weight for each labeller's two votes."""
    width = 1 + 2 * len(LABELLERS)
    out = [[0.0] * width for _ in KINDS]
    for kind in range(len(KINDS)):
        own = [([0] + [1 + 2 * k + votes // 3**k % 3 - 1 for k in range(len(LABELLERS)) if votes // 3**k % 3], n, posterior[kind, votes]) for k_, votes, n in rows if k_ == kind]
        if not own:
            continue
        whole, w = sum(n for _, n, _ in own), out[kind]
        for _ in range(rounds):
            g = [1e-3 * x for x in w]
            for at, n, y in own:
                e = (1 / (1 + math.exp(-max(-60.0, min(60.0, sum(w[k] for k in at))))) - y) * n / whole
                for k in at:
                    g[k] += e
            for k in range(width):
                w[k] -= 1.5 * g[k]
    return out


def _probability(s: Column, weights: list[list[float]]) -> Column:
    table = F.array(*[F.lit(x) for row in weights for x in row])
    width = 1 + 2 * len(LABELLERS)
    z = F.element_at(table, s["kind"] * width + 1)
    for k in range(len(LABELLERS)):
        vote = F.floor(s["votes"] / 3**k) % 3
        z = z + F.when(vote > 0, F.element_at(table, (s["kind"] * width + 1 + 2 * k + vote).cast("int"))).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, base, spans)`` of whole texts, arrays of kind (number), start, end.

    Base spans all stay. Candidates that aren't base are added where the classifier gives them at least
    ``threshold`` and no base span overlaps, nor a likelier one of them (of equally likely ones the first by start, then kind). The labellers' counts come from all candidates of
    all documents; only the table of vote patterns is on the driver.
    """
    found = durable(candidates(docs))
    counted = found.select(F.inline("found")).groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()
    rows = [(r["kind"], r["votes"], float(r["n"])) for r in counted]
    posterior, _ = reliabilities(rows)
    weights = train(rows, posterior)
    base = with_blocks(found.withColumn("base", F.filter("found", lambda s: s["base"])), "base", "blocks")
    field = lambda s: [s[c].alias(c) for c in ("kind", "start", "end")]
    judged = F.transform(F.filter("found", lambda s: ~s["base"] & ~overlaps("blocks", s)), lambda s: F.struct(*field(s), (-_probability(s, weights)).alias("rank")))
    rows = with_blocks(base.withColumn("added", F.filter(judged, lambda s: s["rank"] <= -threshold)), "added", "own", ("kind", "rank"))
    place = lambda s: F.struct(s["rank"], s["start"], s["kind"])
    added = F.filter("added", lambda s: ~overlaps("own", s, lambda x: place(x) < place(s)))
    both = F.concat(F.transform("base", lambda s: F.struct(*field(s))), F.transform(added, lambda s: F.struct(*field(s))))
    return rows.select("doc_id", "base", both.alias("spans"))


def pii_report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Digest of :func:`find`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Null text is empty: no spans, the hash of an empty text. Repeated rows give a row each; no rows,
    none. Ties in start go by kind as listed. Other columns are not looked at.
    """
    found = find(docs, threshold)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
