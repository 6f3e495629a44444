"""Whitening, page text and prefix trie against brute force, with nulls, odd rows, repeats and clashing columns."""

import hashlib
import os
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.llm import html, trie, whitening
from tideglass.llm import queries as q

SF = "/root/testdata/sf0.001"

# whitening


def whitened(spark, table, most=32):
    rows = whitening.whiten(table, most).collect()
    found = {}
    for r in rows:
        found.setdefault(r.vec_id, {})[r.component] = r
    return rows, found


@pytest.mark.parametrize(("dims", "n", "kind"), [(6, 40, "float"), (40, 300, "float"), (5, 4, "double"), (8, 60, "double")])
def test_whitening_equals_an_eigendecomposition(spark, dims, n, kind):
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((n, dims)) @ rng.standard_normal((dims, dims)) * 3
    if kind == "double" and dims == 8:  # repeated and zero deviations
        x[:, 1], x[:, 2] = 4.0, x[:, 3]
    values = [(k, [float(np.float32(c)) for c in row]) for k, row in enumerate(x)]
    table = spark.createDataFrame(values, f"vec_id long, embedding array<{kind}>").repartition(3)
    whole = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in row] for _, row in values], dtype=object)
    total = whole.sum(axis=0)
    centred = np.array((whole * n - total).tolist(), dtype=float) / n
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    keep = [j for j in range(dims - 1, -1, -1) if e[j] > 1e-18 * e[-1] * 1e4][:32]
    rows, found = whitened(spark, table)
    k = min(len(keep), dims, n - 1)
    assert {r.component for r in rows} == set(range(1, len(found[0]) + 1)) and len(found[0]) == len([j for j in keep if e[j] > 1e-12 * e[-1]]) <= k
    for i in range(n):
        assert {r.deviation for r in found[i].values()} == {sum(int(c) ** 2 for c in whole[i] * n - total)}
    for c in found[0]:
        want = centred @ vectors[:, keep[c - 1]] / np.sqrt(e[keep[c - 1]])
        got = np.array([found[i][c].whitened for i in range(n)])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
        assert found[0][c].explained == pytest.approx(e[keep[c - 1]] / e.sum(), rel=1e-9) and found[0][c].identity_error < 1e-8 and found[0][c].n == n


def test_repeated_deviations_lose_no_direction(spark):
    rows = [(i, [float(s * (j == k)) for k in range(4)]) for i, (j, s) in enumerate((j, s) for j in range(4) for s in (1, -1))]
    rows, found = whitened(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert len(found) == 8 and all(set(x) == {1, 2, 3, 4} for x in found.values())
    assert max(r.identity_error for r in rows) < 1e-12 and all(r.explained == pytest.approx(0.25, abs=1e-12) for r in rows)


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, n long, label string"
    good = [(k, [float(k % 3), float(k % 5)], 1, "x") for k in range(15)]
    odd = [(100, None, 1, "x"), (101, [1.0, None], 1, "x"), (102, [1.0, float("nan")], 1, "x"), (103, [float("inf"), 1.0], 1, "x"), (104, [], 1, "x"), (105, [1.0, 2.0, 3.0], 1, "x"), (106, [1e300, 1.0], 1, "x"), (None, [1.0, 1.0], 1, None), (3, [0.0, 3.0], 1, "x")]
    rows, found = whitened(spark, spark.createDataFrame(good + odd, schema))
    assert set(found) == set(range(15)) | {None} and len(rows) == 2 * 17 and {r.n for r in rows} == {17}
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame(good[:1] * 5, schema)).count() == 0
    big = spark.createDataFrame([(k, [float(1 << 40) * (-1) ** k, float(k)]) for k in range(4)], "vec_id long, embedding array<double>")
    rows, _ = whitened(spark, big)
    assert {r.deviation for r in rows} == {None} and len(rows) == 4  # the second deviation is below 1e-9 of the first
    vast = spark.createDataFrame([(k, [float((1 << 50) - k)]) for k in range(70)], "vec_id long, embedding array<double>")
    rows, _ = whitened(spark, vast)
    assert {r.vec_id: r.deviation for r in rows} == {k: (70 * 64 * k - 64 * 69 * 35) ** 2 for k in range(70)}


def test_sums_of_numbers_that_fill_64_bits():
    x = np.array([[1 << 56], [(1 << 56) + 2]], dtype=np.int64)
    assert whitening._centre(x, 2, np.array([(1 << 57) + 2], dtype=np.int64)).ravel().tolist() == [-1.0, 1.0]


# pages

PAGES = {
    "": "",
    "<p>x": "",
    "<html><body><nav><a href=/>Home</a></nav><article><h1>The title</h1><p>One &amp; two &lt;b&gt; &eacute;&nbsp;x<p>Three\n\n four<br>five</article><footer>&copy; us</footer>": "The title\nOne & two <b> é x\nThree four five",
    "<article><script>var a='<p>no</p>'</script><style>p{}</style><p>kept text <!-- <p>gone</p> --> goes on</p><form><p>Your name <input></p></form><aside>side</aside><p>end.</p><div class='comments'><article><p>I like the page of the man and the dog very much, it is the best of all the pages that are here.</p></article></div></article>": "kept text goes on\nend.",
    "<div id=cookie-notice>We use cookies on this site and in the apps, as all of the others do, to make it better for you.</div><main><p>The story of the man who came to the house and was not let in by any of those who were there.</p><p>Yes.</p></main>": "The story of the man who came to the house and was not let in by any of those who were there.\nYes.",
    "<ul><li><a href=1>The first of the long list of links that are in the menu of this page</a><li><a href=2>The second of the long list of links that are in the menu of this page</a></ul><h2>Why it is so</h2><p>" + "It is the way of the world that all that is up must come down, and that is what they say. " * 3 + "</p><p>So be it.</p><p>" + "And it was on the way to the town that he saw her for the first time, as if in a dream. " * 3 + "</p><div>Zip code list</div><div class='foot nav'>Imprint</div>": "Why it is so\n" + ("It is the way of the world that all that is up must come down, and that is what they say. " * 3).strip() + "\nSo be it.\n" + ("And it was on the way to the town that he saw her for the first time, as if in a dream. " * 3).strip(),
    "<article><p>" + "zwk | plq | xrr | " * 20 + "</p><p>vvv</p></article>": ("zwk | plq | xrr | " * 20).strip() + "\nvvv",
    "<body><form action=x><article class='post has-sidebar'><header class='entry-header'><h1>Head</h1></header><p>Text of it.</p></article><p>Search</p></form>": "Head\nText of it.",
    "<article><p>a < b and c > d, 3 <4 \"quoted<p>it's</article>": "a < b and c > d, 3 <4 \"quoted\nit's",
    "<article><p title=\"a > b\">in</p><p title=\"open>text</p><p>more</p></article>": "in\ntext\nmore",
    "<article><p>cut off in a tag <a hre": "cut off in a tag",
    "<article><h1>T</h1><ul><li><a>one thing and the other</a></li></ul></article>": "T",
}


def test_pages(spark):
    rows = [(k, f"u{k}", h, "x", 1) for k, h in enumerate(PAGES)] + [(None, None, None, "x", 1), (3, "u", list(PAGES)[2], "x", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = html.main_text(table)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.url: r for r in got.collect()}
    for k, (_, want) in enumerate(PAGES.items()):
        assert (found[f"u{k}"].text, found[f"u{k}"].n_chars) == (want, len(want)), k
    assert found[None].text == "" and found["u"].text == list(PAGES.values())[2] and got.count() == len(rows)
    assert html.main_text(table.limit(0)).count() == 0


def test_long_and_hostile_pages_take_no_square_time():
    n = 200_000
    for page in ("<div>" * n + "</section>" * n, "<a " * n + '"', "<!--" * n, "<p>" * n + "word " * n, "<script>" * n, "<" * n, "<li class=ad>x" * 20_000):
        assert len(html.page_texts([page])) == 1
    assert html.page_texts(["<article>" + "<p>the one</p>" * n])[0].count("\n") == n - 1


class Plain(HTMLParser):
    """Text of an article by the standard parser, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.inside = [""], False

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.out.append("")
        elif tag == "br":
            self.out[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.out.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.out[-1] += data


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_articles_equal_those_of_the_standard_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r.text for r in q.op12_html(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        plain = Plain()
        plain.feed(p.html)
        assert got[p.page_id] == "\n".join(x for x in (" ".join(x.split()) for x in plain.out) if x)


def brute_label(blocks):
    """The two passes for pages without articles, one block at a time."""
    labels = []
    known = any(c >= 70 and s >= 0.15 and not a for c, s, _, a, _, _ in blocks)
    for c, s, linked, a, heading, mark in blocks:
        if a or linked / c > 0.2 or mark:
            labels.append(False)
        elif c >= 70 and (s >= 0.25 or (s >= 0.15 and c > 200)):
            labels.append(True)
        elif heading:
            labels.append(None)
        elif c >= 70:
            labels.append(True if not known else False if s < 0.15 else None)
        else:
            labels.append(False if linked else None)
    out = []
    for k, x in enumerate(labels):
        if x is not None:
            out.append(x)
            continue
        before = [j for j in range(k) if labels[j] is not None][-1:]
        after = [j for j in range(k + 1, len(labels)) if labels[j] is not None][:1]
        if blocks[k][4]:
            out.append(any(labels[j] for j in after))
        else:
            near = min([abs(j - k) for j in before + after], default=0)
            out.append(bool(before + after) and all(labels[j] for j in before + after if abs(j - k) == near))
    return out


def test_labels_equal_a_plain_loop():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pages = [[(int(rng.choice([5, 60, 70, 150, 201, 400])), float(rng.choice([0, 0.1, 0.15, 0.2, 0.25, 0.5])), int(rng.choice([0, 0, 0, 3])), bool(rng.random() < 0.2), bool(rng.random() < 0.2), bool(rng.random() < 0.05)) for _ in range(rng.integers(1, 12))] for _ in range(3)]
        page = np.repeat(np.arange(3), [len(p) for p in pages])
        c, s, linked, a, heading, mark = (np.array(x) for x in zip(*[b for p in pages for b in p], strict=True))
        got = html.label(page, c, s, linked, a, np.zeros(len(page), dtype=int), heading, mark)
        assert got.tolist() == [x for p in pages for x in brute_label(p)]


# trie


def brute_trie(rows):
    convs = {}
    for c, turn, role, text, h1, h2 in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0, h1, h2), (role or "", text or "")))
    stored = {c: [t for _, t in sorted(ts, key=lambda t: t[0])] for c, ts in convs.items()}
    rebuilt = {}
    for c, ts in stored.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = stored.get(c - c % 20, [])[:h] + ts[h:]
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = set()
    for k, cs in members.items():
        below = [x for x in members if x[: len(k)] == k]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(rebuilt[c]) == len(k)))
        children = sum(len(x) == len(k) + 1 for x in below)
        out.add((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string, depth int, n long"


def hashed(table):
    """The rows with the hashes by which equal turns are ordered."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return table.select("conv_id", "turn", "role", "text", F.xxhash64(F.lit(0), role, text).alias("h1"), F.xxhash64(F.lit(-1), text, role).alias("h2")).collect()


def test_trie_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in [*range(3, 50), 100, 119, 120, 4000]:
        rows += [(c, int(t), ["user", "bot"][t % 2], "w " * int(rng.integers(0, 3)), 1, 1) for t in range(rng.integers(1, 7))]
    rows += [(20, None, None, None, 1, 1), (20, 2, "user", "tie a", 1, 1), (20, 2, "user", "tie b", 1, 1), (41, 0, "user", "twice", 1, 1), (41, 0, "user", "twice", 1, 1), (None, 0, "user", "lost", 1, 1), (7, 9, "user", "x" * 100_000 + " y", 1, 1)]
    table = spark.createDataFrame(rows, TURNS).repartition(5)
    got = trie.prefix_trie(table)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = got.collect()
    assert {tuple(r) for r in found} == brute_trie(hashed(table)) and len(set(found)) == len(found)
    assert trie.prefix_trie(table.limit(0)).count() == 0


def test_one_conversation_of_most_turns_and_copies(spark):
    rows = [(40, t, "user", f"w{t % 7}", 1, 1) for t in range(1500)] + [(c, t, "user", f"w{t}", 1, 1) for c in range(41, 60) for t in range(3)]
    table = spark.createDataFrame(rows, TURNS).repartition(4)
    found = trie.prefix_trie(table).collect()
    assert max(r.depth for r in found if r.conv_id == 40) == 1500 and sum(r.n_convs for r in found if r.depth == 1) <= 20
    root = next(r for r in found if r.depth == 0)
    assert root.n_convs == 20 and root.n_leaves == sum(r.n_children == 0 for r in found)
    assert root.saved_tokens == sum(r.n_convs - 1 for r in found if r.depth)


def test_fingerprints_that_meet_are_found_and_made_again(spark, monkeypatch):
    """With a tiny prime nearly all fingerprints meet: the check sees it and other multipliers are taken."""
    tried = []
    real = trie.multipliers

    def counted(seed, prime):
        tried.append(seed)
        return real(seed, prime if len(tried) > 1 else 5)

    monkeypatch.setattr(trie, "multipliers", counted)
    monkeypatch.setattr(trie, "_lanes", lambda h1, h2, prime, real=trie._lanes: [x * 0 + 1 for x in real(h1, h2, prime)] if len(tried) == 1 else real(h1, h2, prime))
    rows = [(c, t, "user", f"{c} {t}", 1, 1) for c in range(4) for t in range(3)]
    table = spark.createDataFrame(rows, TURNS)
    found = {tuple(r)[:3] for r in trie.prefix_trie(table).collect()}
    assert tried == [0, 1] and found == {x[:3] for x in brute_trie(hashed(table))}


def test_turns_of_equal_hashes_but_other_texts_are_seen(spark):
    same = spark.createDataFrame([(1, 2, "user", "a"), (1, 2, "user", "a"), (1, 3, "user", "b")], "h1 long, h2 long, role string, text string")
    assert trie.same_contents(same) and not trie.same_contents(same.union(spark.createDataFrame([(1, 2, "user", "c")], same.schema)))


def test_products_compose(spark):
    by = trie.Powers(7, 1_000_003)
    ns = [0, 1, 5, 63, 64, 100_000, 1 << 30]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", by.up(F.col("n")).alias("p")).collect()
    assert {r.n: r.p for r in got} == {n: pow(7, n, 1_000_003) for n in ns}


def test_webp_depths_are_those_of_a_heap():
    import heapq

    from tideglass.llm import webp

    rng = np.random.default_rng(21)
    for n in (1, 2, 3, 19, 60, 280):
        for top in (2, 5, 1000, 10**9):
            weights = [int(w) for w in rng.integers(1, top, n)]
            heap = [(w, k) for k, w in enumerate(weights)]
            heapq.heapify(heap)
            above = {}
            for new in range(n, 2 * n - 1):
                (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
                above[x] = above[y] = new
                heapq.heappush(heap, (a + b, new))
            depth = lambda k: 1 + depth(above[k]) if k in above else 0
            assert webp._depths(weights, 300) == ([depth(k) for k in range(n)] if n > 1 else [1])
            short = webp._depths(weights, 15)
            assert max(short) <= 15 and (n == 1 or sum(2.0**-d for d in short) == 1.0)


def test_webp_headers_are_not_read_symbol_by_symbol(monkeypatch):
    from tideglass.llm import webp

    payload = webp.pad("The quick brown fox jumps over the lazy dog, 0123456789 times; WHY? " + "".join(chr(33 + k * 7 % 90) for k in range(300)))[0]
    media, peeks, plain = webp.store(payload), [], webp.Bits.peek
    monkeypatch.setattr(webp.Bits, "peek", lambda self, n: peeks.append(n) or plain(self, n))
    assert webp.load(media) == payload
    assert len(peeks) < 90
    cut = media[:20] + media[20:60]
    with pytest.raises(ValueError):
        webp.load(cut[:4] + (len(cut) - 8).to_bytes(4, "little") + cut[8:16] + (len(cut) - 20).to_bytes(4, "little") + cut[20:])
