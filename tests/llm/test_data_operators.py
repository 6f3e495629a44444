"""Mixing, packing, embeddings, media and the pipeline on small tables."""

import bisect
import struct
import zlib

import numpy as np
import pytest

from tideglass.llm import mixing, packing, vectors, webp


def fill(sizes, weights, share, most):
    """Targets by the rule as it is told: deal by weight, cap, deal the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, rest = {s: 0.0 for s in names}, set(names), share * sum(sizes.values())
    while rest > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / whole
        rest = 0.0
        for s in list(open_):
            if target[s] > most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_targets_follow_the_rule(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 23):
        sizes = {f"s{k}é"[: 2 + k % 3] + str(k): int(x) for k, x in enumerate(rng.integers(0, 1000, n))} | {None: 50}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        for s, t in fill(sizes, (5, 2, 1), 1.5, 2).items():
            assert found[s] == pytest.approx(t, abs=1e-6), (n, s)


def test_mix_repeats_by_rate(spark):
    rows = [(k, "w " * (k % 7), f"s{k % 4}" if k % 9 else None, 5) for k in range(2000)] + [(None, None, None, 1), (5000, "", "s0", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copies long")
    report = mixing.mix_report(table).collect()
    again = {(r.doc_id, r.copies) for r in mixing.mix_report(table.repartition(7)).collect()}
    assert {(r.doc_id, r.copies) for r in report} == again
    assert all(r.taken <= 2 * r.size for r in report)
    for s in {r.source for r in report}:
        own = [r for r in report if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.1)
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns and mixed.count() == sum(r.copies for r in report)
    assert mixing.mix(table.limit(0)).count() == 0


def best_fit(counts, capacity):
    gaps, n = [], 0
    for a in sorted(counts, reverse=True):
        for _ in range(counts[a]):
            at = bisect.bisect_left(gaps, a)
            n += at == len(gaps)
            gap = capacity if at == len(gaps) else gaps.pop(at)
            bisect.insort(gaps, gap - a)
    return n


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    lengths, n = np.unique(rng.integers(1, capacity + 1, 500), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist(), strict=True))
    kinds = packing.plan(counts, capacity)
    used = {}
    for parts, k in kinds:
        assert sum(parts) <= capacity
        for x in parts:
            used[x] = used.get(x, 0) + k
    assert used == counts
    least = -(-sum(x * k for x, k in counts.items()) // capacity)
    assert least <= sum(k for _, k in kinds) <= best_fit(counts, capacity) * 1.01 + 1


def test_exact_complements_fill():
    assert packing.plan({40: 3, 24: 3, 29: 2, 20: 2, 15: 2, 31: 1, 19: 1, 9: 1, 5: 1}, 64) == [((29, 20, 15), 2), ((31, 19, 9, 5), 1), ((40, 24), 3)]


def test_pairs_are_indexed_by_their_sum():
    lengths = np.array([1, 2, 3, 5, 8, 13])
    index = packing.pair_index(lengths, 20)
    for total in range(21):
        want = [x for x in range(total // 2, 0, -1) if x in lengths and total - x in lengths]
        assert index[total].tolist() == want


def test_sums_of_one_two_and_three_all_fill_gaps():
    """On lengths like those of documents, kinds of two, three and four pieces are used, and nothing is longer than best fit."""
    rng = np.random.default_rng(11)
    lengths, n = np.unique(np.clip((rng.lognormal(5.8, 1.0, 20_000)).astype(int), 1, 2048), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist(), strict=True))
    kinds = packing.plan(counts, 2048)
    exact = {len(parts) for parts, _ in kinds if sum(parts) == 2048}
    assert {2, 3, 4} <= exact
    least = -(-sum(x * k for x, k in counts.items()) // 2048)
    assert least <= sum(k for _, k in kinds) <= min(best_fit(counts, 2048), least + 2)


def test_packed_pieces_give_the_documents_back(spark):
    from tokenizers import Tokenizer

    files = packing.public_vocabulary()
    whole = Tokenizer.from_file(files[0])
    texts = ["the cat  sat\n\non the mat", None, "", "word " * 300, "Größe 中文 <|endoftext|> x", "tail "] * 3 + ["a b c"]
    table = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "null id", 1)], "doc_id long, text string, length long")
    packed = packing.pack(packing.pieces(table, capacity=64), 64).collect()
    for k, text in enumerate(texts):
        own = sorted((r for r in packed if r.doc_id == k), key=lambda r: r.piece)
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert all(r.length == 64 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in own)
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(table.limit(0)).count() == 0
    assert packing.sequences(table, capacity=64).count() == len(by)


def test_the_plan_goes_to_executors_without_python_rows(spark):
    """Rows of Python objects would be a scan of an RDD that Python workers of a second kind read, on every executor."""
    found = spark.range(40).selectExpr("id as doc_id", "0 as piece", "1 + id % 7 as length")
    placed = packing.pack(found, 16)
    assert "RDD" not in placed._jdf.queryExecution().analyzed().toString()
    rows = placed.collect()
    assert len(rows) == 40 and all(r.offset + r.length <= 16 for r in rows)


def test_encoder_equals_the_tokenizer():
    import random

    files = packing.public_vocabulary()
    encode = packing.Encoder(*files)
    draw = random.Random(3)
    parts = ["a", "the", " ", "\n", " ", "é", "'s", "12", "!!", "\t", "word", "ß", "中", "<|endoftext|>", " ", " ", "\x1c"]
    for _ in range(1500):
        x = "".join(draw.choice(parts) for _ in range(12))
        assert encode(x) == np.array(encode.whole.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(x)


def test_new_words_of_a_text_are_encoded_at_once(monkeypatch):
    """Three texts of 400 new words take a call each, and one for each first word of a line; ids are the tokenizer's, also with few words kept."""
    from types import SimpleNamespace

    texts = [" ".join(f"{'aé' * (k % 3)}w{k * 7919 + n}x" for k in range(400)) + " 中 end " for n in range(3)]
    encode = packing.Encoder(*packing.public_vocabulary())
    calls, real = [], encode.part.encode_ordinary
    encode.part = SimpleNamespace(encode_ordinary=lambda text: calls.append(text) or real(text))
    whole = lambda text: np.array(encode.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert [encode(t) for t in texts] == [whole(t) for t in texts] and len(calls) < 15
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    assert [encode(t) for t in texts * 2] == [whole(t) for t in texts * 2]


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    points = rng.standard_normal((120, 16))
    rows = [(k, [float(v) for v in x], k % 3) for k, x in enumerate(points)]
    rows += [(200 + k, [float(v) for v in 3 * points[k] + 0.15 * rng.standard_normal(16)], k % 3) for k in range(60)]
    rows += [(300 + k, [float(v) for v in points[0]], 0) for k in range(5)]
    odd = [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] + [1.0] * 15, 1), (404, [1.0, 2.0], 1), (405, [float(v) for v in points[0]], None), (406, [float("inf")] + [1.0] * 15, 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(vectors, "TILE", 16)
    found = {r.vec_id: r for r in vectors.near_vectors(frame).collect()}
    x = np.array([np.array(r[1], dtype=np.float32).astype(float) for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, label = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    group = ids.copy()
    while True:
        new = np.array([min(group[k], group[near[k]].min()) if near[k].any() else group[k] for k in range(len(ids))])
        if (new == group).all():
            break
        group = new
    for k, i in enumerate(ids.tolist()):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (near[k].sum(), group[k], group[k] == i)
    for i, *_ in odd:
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turned, codes, factors = vectors.encode(x, vectors.rotation(32, 128))
    guess, off = vectors.estimate(turned, codes, factors)
    near = x[:200] + 0.02 * rng.standard_normal((200, 32))
    near /= np.linalg.norm(near, axis=1)[:, None]
    _, more, theirs = vectors.encode(near, vectors.rotation(32, 128))
    one = np.ones(200, dtype=np.int64)
    linked, links, computed = vectors.compare(x[:200], near, one, one, more, theirs, vectors.rotation(32, 128), 0.93)
    assert (linked[:200] == (x[:200] @ near.T >= 0.93).sum(axis=1)).all() and len(links) == 200
    assert computed < 0.05 * 200 * 200  # of all pairs
    error = guess - x @ x.T
    assert abs(error[~np.eye(400, dtype=bool)].mean()) < 0.005
    assert (np.abs(error) <= off + 1e-5).all()


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def code(self, lengths):
        """A prefix code with plain code lengths of 4 bits each; gives how to write its symbols."""
        lengths = np.array(lengths)
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(int(used[0]) if len(used) else 0, 8)
            return lambda s: None
        self.put(0, 1), self.put(15, 4)
        for k in webp.LENGTH_ORDER:
            self.put(4 if k < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths.tolist():
            self.put(int(f"{n:04b}"[::-1], 2), 4)
        table, code, last = {}, 0, 0
        for n, s in sorted((int(lengths[s]), int(s)) for s in used):
            code <<= n - last
            table[s] = f"{code:0{n}b}"
            code, last = code + 1, n
        return lambda s: self.bits.extend(int(c) for c in table[s])

    def literals(self, pixels, main):
        """An image of literals under balanced codes."""
        self.put(0, 1)
        if main:
            self.put(0, 1)
        flat = pixels.view(np.uint8).reshape(-1, 4)
        write = [self.code([8] * 256 + [0] * 24), self.code([8] * 256), self.code([8] * 256), self.code([8] * 256), self.code([1] + [0] * 39)]
        for b, g, r, a in flat.tolist():
            for w, v in zip(write, (g, r, b, a), strict=False):
                w(v)

    def file(self, width, height, steps):
        head = Writer()
        head.put(width - 1, 14), head.put(height - 1, 14), head.put(1, 1), head.put(0, 3)
        return webp.riff(np.array(head.bits + self.bits))


def picture(width, height, seed=1):
    return np.random.default_rng(seed).integers(0, 2**32, width * height, dtype=np.uint64).astype(np.uint32)


def test_all_transforms_are_undone():
    width, height, shift = 13, 9, 2
    p = picture(width, height)
    blocks = -(-width // 4) * -(-height // 4)
    modes = (np.arange(blocks, dtype=np.uint32) % 14) << np.uint32(8)
    factors = picture(blocks, 1, 5)
    w = Writer()
    w.put(1, 1), w.put(webp.PREDICTOR, 2), w.put(shift - 2, 3), w.literals(modes, False)
    w.put(1, 1), w.put(webp.CROSS_COLOUR, 2), w.put(shift - 2, 3), w.literals(factors, False)
    w.put(1, 1), w.put(webp.SUBTRACT_GREEN, 2), w.put(0, 1)
    inner = webp.green_all(webp.cross_all(webp.predict_all(p, width, height, shift, modes, False), width, height, shift, factors, False), False)
    w.literals(inner, True)
    got = webp.decode_image(w.file(width, height, None))
    assert (got.reshape(-1, 4).copy().view(np.uint32)[:, 0] == p).all()


@pytest.mark.parametrize("colours", [2, 4, 11, 40])
def test_palettes(colours):
    width, height = 11, 6
    palette = picture(colours, 1, 2)
    number = np.random.default_rng(3).integers(0, colours, width * height)
    steps = palette.view(np.uint8).reshape(-1, 4).copy()
    steps[1:] -= palette.view(np.uint8).reshape(-1, 4)[:-1]
    shift = webp._bundle(colours)
    rows = []
    for row in number.reshape(height, width).tolist():
        for at in range(0, width, 1 << shift):
            rows.append(sum(v << (k * (8 >> shift)) for k, v in enumerate(row[at : at + (1 << shift)])) << 8)
    w = Writer()
    w.put(1, 1), w.put(webp.PALETTE, 2), w.put(colours - 1, 8), w.literals(steps.view(np.uint32)[:, 0], False), w.put(0, 1)
    w.literals(np.array(rows, dtype=np.uint32), True)
    got = webp.decode_image(w.file(width, height, None)).reshape(-1, 4).copy().view(np.uint32)[:, 0]
    assert (got == palette[number]).all()


def test_copies_cache_and_groups():
    """Literals of two groups, a copy from the row above, a long overlapping copy, and a cached pixel."""
    width, height = 8, 4
    w = Writer()
    w.put(0, 1)
    w.put(1, 1), w.put(3, 4)  # colour cache of 8 pixels
    w.put(1, 1), w.put(0, 3)  # groups in blocks of 4 x 4
    w.put(0, 1)
    write = [w.code([0] * 280) if k else w.code([1, 1] + [0] * 278) for k in range(1)] + [w.code([0] * 256) for _ in range(3)] + [w.code([0] * 40)]
    write[0](0), write[0](1)
    groups = []
    for first in (10, 200):
        green = [0] * 288
        green[first] = green[first + 1] = green[256] = 2  # a literal, the next one, copies of one pixel
        green[256 + 4] = 3  # copies of five and more
        green[280 + ((0x1E35A7BD * (0xFF000000 | 10 << 8) & 0xFFFFFFFF) >> 29)] = 3  # the cached pixel
        groups.append([w.code(green), w.code([0] * 256), w.code([0] * 256), w.code([0] * 255 + [1]), w.code([1, 1] + [0] * 38)])
    out = []
    for at in range(width):
        g = 0 if at % 8 < 4 else 1
        v = (10 if not g else 200) + at % 2
        groups[g][0](v)
        out.append(0xFF000000 | v << 8)
    groups[0][0](256), groups[0][4](0)  # one pixel from the place above
    out.append(out[len(out) - width])
    groups[0][0](260), w.put(1, 1), groups[0][4](1)  # six pixels from the left
    out += [out[-1]] * 6
    groups[1][0](201), out.append(0xFF000000 | 201 << 8)
    groups[0][0](280 + ((0x1E35A7BD * (0xFF000000 | 10 << 8) & 0xFFFFFFFF) >> 29)), out.append(0xFF000000 | 10 << 8)
    while len(out) < width * height:
        g = 0 if len(out) % 8 < 4 else 1
        groups[g][0](10 if not g else 200)
        out.append(0xFF000000 | (10 if not g else 200) << 8)
    got = webp.decode_image(w.file(width, height, None)).reshape(-1, 4).copy().view(np.uint32)[:, 0]
    assert got.tolist() == out


def test_payloads_come_back(spark):
    texts = [None, "", "a" * 63, "\0" * 64, "é" * 700_000, "plain text", "plain text", bytes(range(128)).decode()]
    table = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in webp.media_report(table).collect()}
    import hashlib

    for k, t in enumerate(texts):
        payload, n = webp.pad(t)
        assert (rows[k].n_bytes, rows[k].payload_bytes) == (n, len(payload))
        assert rows[k].payload_sha256 == hashlib.sha256(payload).hexdigest() and rows[k].tail_crc32 == zlib.crc32(payload[-64:])
    assert rows[5][2:] == rows[6][2:]
    pixels = webp.pixel_arrays(webp.media_column(table.where("doc_id = 5"))).first()
    assert bytes(pixels.pixels[::4]) == webp.pad("plain text")[0] and pixels.width == 64
    assert webp.media_report(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        webp.decode_image(webp.store(webp.pad("text that is cut")[0])[:40])


def payloads():
    rng = np.random.default_rng(3)
    plain = "Words of a text that has lines.\nAnd some more words, with others in between. "
    return {
        "plain": (plain * 40).encode()[: 64 * 40],
        "palette": rng.integers(48, 50, 6400, dtype=np.uint8).tobytes(),
        "left": np.cumsum(rng.integers(0, 3, 64 * 300)).astype(np.uint8).tobytes(),
        "upper": (np.arange(64, dtype=np.uint8) * 37 + np.cumsum(rng.integers(0, 2, (200, 64)), axis=0)).astype(np.uint8).tobytes(),
    }


@pytest.mark.parametrize("form", ["plain", "palette", "left", "upper"])
def test_the_shortest_form_is_written_and_read(form):
    payload = payloads()[form]
    found = {name: len(bits) for name, bits in webp.forms(np.frombuffer(payload, dtype=np.uint8))}
    assert min(found, key=found.get) == form
    assert webp.load(webp.store(payload)) == payload


def test_copies_are_written_where_samples_repeat():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        part = rng.integers(0, 256, rng.integers(1, 200), dtype=np.uint8)
        samples = np.resize(np.concatenate([part, rng.integers(0, 4, 50, dtype=np.uint8), part]), 64 * int(rng.integers(1, 300)))
        made, at = webp.copies(samples), 0
        for start, length, back in made:
            assert start >= at and back <= start and 7 <= length <= 4096
            assert all(samples[start + k] == samples[start + k - back] for k in range(length))
            at = start + length
        assert webp.load(webp.store(samples.tobytes())) == samples.tobytes()


def test_code_lengths_are_complete_and_limited():
    for counts in ([1, 1], [5, 0, 1], [2**k for k in range(30)], np.random.default_rng(1).integers(0, 50, 280).tolist()):
        lengths = webp.code_lengths(np.array(counts), 15)
        assert (lengths[np.array(counts) == 0] == 0).all() and lengths.max() <= 15
        assert sum(2.0 ** -int(x) for x in lengths if x) == 1.0


def test_one_prediction_for_all_is_undone_in_bulk():
    pixels = picture(64, 20, 4)
    for mode in (1, 2):
        modes = np.full(1, mode << 8, dtype=np.uint32)
        residuals = webp.predict_all(pixels, 64, 20, 9, modes, False)
        assert (webp.predict_all(residuals, 64, 20, 9, modes, True) == pixels).all()


def test_feature_of_ties_constants_and_short_payloads():
    assert webp.feature(np.zeros(64, dtype=np.uint8)) == "0.0000|0.0000|0.0000|" + "0" * 16
    one = np.zeros(64, dtype=np.uint8)
    one[3] = 64
    assert webp.feature(one).split("|")[0] == "1.0000" and int(webp.feature(one).split("|")[3], 16) == 1 << 3
    half = np.repeat(np.array([0, 2], dtype=np.uint8), 32)
    assert webp.feature(half) == f"1.0000|1.0000|1.0000|{((1 << 32) - 1) << 32:016x}"


def test_near_table_is_whole():
    assert len(webp.NEAR) == len(set(webp.NEAR)) == 120
    assert struct.unpack("<I", webp.store(b"\0" * 64)[4:8])[0] + 8 == len(webp.store(b"\0" * 64))


def test_vectors_of_another_length_change_only_themselves(spark):
    rng = np.random.default_rng(8)
    point, other = rng.standard_normal(16), rng.standard_normal(17)
    rows = [(k, [float(v) for v in point], 0) for k in range(3)] + [(10, [float(v) for v in point + 0.01], 0)]
    rows += [(20, [float(v) for v in other], 0), (21, [float(v) for v in 2 * other], 0), (30, [float(v) for v in rng.standard_normal(130)], 0)]
    found = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert [(found[k].n_links, found[k].component_id) for k in (0, 1, 2, 10)] == [(3, 0)] * 4
    assert [(found[k].n_links, found[k].component_id) for k in (20, 21, 30)] == [(1, 20), (1, 20), (0, 30)]
