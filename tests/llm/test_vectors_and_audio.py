"""Embeddings and audio against plain versions; components."""

import random
from itertools import combinations

import numpy as np
from helpers import awkward, groups
from pyspark.sql import functions as F

from kairograph.llm import audio, embedding_dedup
from kairograph.llm import components as stars
from kairograph.llm.components import components


def test_components_of_chains_stars_and_repeats(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (300, 301)]
    rnd.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 140)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_take_no_rounds_and_give_what_rounds_do(spark, monkeypatch):
    written, whole = [], stars.cut
    monkeypatch.setattr(stars, "cut", lambda df, label: written.append(label) or whole(df, label))
    rnd = random.Random(6)
    pairs = [(i, i + 1) for i in range(300)] + [(rnd.randrange(400, 600), rnd.randrange(400, 600)) for _ in range(120)]
    key = lambda x: bytes([x * 37 % 251, x % 256, x // 256])
    for rows, kind in ((pairs, "long"), ([(key(a), key(b)) for a, b in pairs], "binary")):
        edges = spark.createDataFrame(rows, f"a {kind}, b {kind}")
        few = components(edges)
        assert few.dtypes == [("node", edges.dtypes[0][1]), ("root", edges.dtypes[0][1])]
        assert written == ["edges", "components"]
        with monkeypatch.context() as m:
            m.setattr(stars, "FEW", 0)
            assert sorted(map(tuple, few.collect())) == sorted(map(tuple, components(edges).collect()))
        assert len(written) > 6
        written.clear()


def test_embeddings_match_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = list(rng.normal(size=(300, 16)))
    x += [x[k % 20] + rng.normal(size=16) * 0.12 for k in range(200)] + [x[0] * 3.0, x[1], x[1]]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] + [1.0] * 15), (1005, [None] * 16), (1006, [1.0] * 3), (1007, [2.0] * 3)]
    monkeypatch.setattr(embedding_dedup, "PER_CELL", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 16 * 16 * 8)
    df = awkward(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.dedup_embeddings(df).collect()}
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(m @ m.T >= 0.95, 1))
    plain = groups([*zip(i.tolist(), j.tolist(), strict=True), (1006, 1007)], [r[0] for r in rows + odd])
    assert {k: v[:2] for k, v in got.items()} == plain
    assert all(v[2] == (k == v[1]) for k, v in got.items())
    assert embedding_dedup.dedup_embeddings(df.limit(0)).count() == 0


def test_vectors_large_small_or_several_of_one_id(spark):
    rows = [(1, [1e200, 1.0]), (2, [1.0, 0.0]), (3, [1e-200, 0.0]), (4, [5e-324, 0.0]), (5, [0.0, 1e300]), (7, [0.0, 1.0, 0.0]), (7, [0.0, 1.0, 0.1]), (8, [0.0, 2.0, 0.0]), (8, [0.0, 2.0, 0.0]), (None, [0.0, 1.0, 0.0])]
    got = sorted((tuple(r) for r in embedding_dedup.dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    # the second vector of 7 links with its first and with 8, those two with each other and with it
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 0, 5, True), (7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False), (8, 2, 7, False), (None, 0, None, True)], key=str)


def test_recordings_align_where_they_share_a_stretch(spark):
    rnd = random.Random(6)
    words = lambda n: [f"w{rnd.randrange(10**8)}" for _ in range(n)]
    shared = words(40)
    texts = {1: words(20) + shared + words(5), 2: shared + words(30), 3: words(60), 4: words(4), 5: [], 7: words(9) + shared[:20] + ["x"] + shared[21:]}
    rows = [(k, " ".join(v)) for k, v in texts.items()] + [(6, None), (8, " ".join(texts[3])), (None, "a b c")]
    prints = audio.fingerprints(spark.createDataFrame(rows, "rec_id long, text string"), audio.render).cache()
    got = {r["rec_id"]: (r["class_id"], r["n_links"], r["component_id"]) for r in audio.align_recordings(prints).collect()}
    assert got == {1: (1, 2, 1), 2: (2, 2, 1), 7: (7, 2, 1), 3: (3, 1, 3), 8: (3, 1, 3), 4: (4, 0, 4), 5: (5, 0, 5), 6: (6, 0, 6), None: (None, 0, None)}
    assert audio.align_recordings(prints.limit(0)).count() == 0
    i, j, offset = audio.align(*[[audio.fingerprint(audio.chroma(audio.render(" ".join(texts[k]))))] for k in (1, 2)], same=False)
    assert offset.tolist() == [-20]


def plain_alignments(ints, keyed=True):
    """Pairs aligned at any offset, looked at one by one; with ``keyed`` only where they share a key."""
    out, keys = set(), {k: dict(zip(*map(np.ndarray.tolist, audio.selected(x)), strict=True)) for k, x in ints.items()}
    for (a, x), (b, y) in combinations(ints.items(), 2):
        for o in range(-len(x) + 1, len(y)):
            if keyed and not any(keys[b].get(p + o) == h for p, h in keys[a].items()):
                continue
            s, e = max(0, -o), min(len(x), len(y) - o)
            best, best_hits, total, hits = 0, 0, 0, 0
            for n in np.bitwise_count(x[s:e] ^ y[s + o : e + o]).tolist():
                if total <= 0:
                    total, hits = 0, 0
                total, hits = total + 640 - 100 * n, hits + (n == 0)
                if total > best:
                    best, best_hits = total, hits
            if best_hits >= audio.MIN_HITS:
                out.add((a, b))
                break
    return out


def hop_prints(pcm):
    return audio.fingerprint(audio.chroma(pcm, hop=audio.FRAME // audio.STEP), audio.STEP)


def test_alignments_match_every_pair_and_offset(spark, monkeypatch):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    draw = lambda n: [rnd.choice(words) for _ in range(n)]
    rows, base = [], draw(60)
    for k in range(25):
        w = draw(rnd.randrange(0, 30))
        lo = rnd.randrange(0, 50)
        part = base[lo : lo + rnd.randrange(4, 40)]
        for _ in range(rnd.randrange(3)):
            part[rnd.randrange(len(part))] = rnd.choice(words)
        rows.append((k, " ".join(w + part + draw(rnd.randrange(0, 20)))))
    rows += [(30, "la " * 200), (31, "la " * 260), (32, "so la " * 90), (33, " ".join(base)), (34, " ".join(base)), (34, " ".join(base))]
    ints = {k: hop_prints(audio.render(t)) for k, t in rows}
    pairs = plain_alignments(ints)
    assert 15 < len(pairs) < 300 and (30, 31) in pairs
    assert len(pairs) >= 0.9 * len(plain_alignments(ints, keyed=False))
    plain = groups(pairs, list(ints))
    monkeypatch.setattr(audio, "BLOCK", 2000)
    prints = audio.fingerprints(spark.createDataFrame(rows, "rec_id long, text string"), audio.render).cache()
    got = {r["rec_id"]: (r["n_links"], r["component_id"]) for r in audio.align_recordings(prints).collect()}
    assert got == plain
    monkeypatch.setattr(audio, "AT_ONCE", 500)
    names = list(ints)
    i, j, _ = audio.align(list(ints.values()), list(ints.values()), same=True)
    assert {(names[x], names[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)} == pairs


def test_cuts_inside_a_frame_still_align():
    rnd = random.Random(9)
    song = audio.render(" ".join(f"w{rnd.randrange(10**6)}" for _ in range(120)))
    whole = hop_prints(song)
    for cut_at in (1, 31, 32, 33, 64, 100, 128, 200, 255, 1000, 5003):
        i, _, offset = audio.align([hop_prints(song[cut_at:])], [whole], same=False)
        assert len(i) == 1 and abs(offset[0] - cut_at / 64) < 1


def test_recordings_short_repeated_or_long(spark):
    rows = [((1, 0), "a b c"), ((2, 0), "a b c"), ((2, 1), "a b d"), ((3, 0), " "), ((4, 0), ""), ((10**13, None), "la " * 4000), ((5, 1), "la " * 2000), ((None, 7), "a b c"), ((6, 0), "a b c"), ((6, 0), "x y z")]
    df = spark.createDataFrame(rows, "rec_id struct<conv:long,turn:long>, text string")
    prints = audio.fingerprints(df, audio.render).cache()
    got = sorted(((tuple(r["rec_id"]), r["n_ints"], tuple(r["class_id"]), r["n_links"], tuple(r["component_id"])) for r in audio.align_recordings(prints).collect()), key=str)
    none = (None, 7)
    want = [((1, 0), 0, none, 3, none), ((2, 0), 0, none, 3, none), ((2, 1), 0, (2, 1), 0, (2, 1)), ((3, 0), 0, (3, 0), 0, (3, 0)), ((4, 0), 0, (4, 0), 0, (4, 0)), ((5, 1), 7969, (5, 1), 1, (5, 1)), ((10**13, None), 15969, (10**13, None), 1, (5, 1)), (none, 0, none, 3, none), ((6, 0), 0, none, 3, none), ((6, 0), 0, (6, 0), 0, (6, 0))]
    assert got == sorted(want, key=str)


def test_chroma_of_a_pure_tone_and_pcm_samples():
    t = np.arange(4096) / audio.RATE
    image = audio.chroma(np.sin(2 * np.pi * audio.LOW_C * 2 ** (9 / 12) * t) * 1000)
    assert image.argmax(axis=1).tolist() == [9] * 16 and image.sum(axis=1).round(6).tolist() == [1.0] * 16
    assert audio.chroma(np.zeros(1000)).sum() == 0
    assert audio.decode_pcm(np.array([1, -2], dtype="<i2").tobytes()).tolist() == [1.0, -2.0] and len(audio.decode_pcm(None)) == 0
    # The integral image gives the sums of its rectangles.
    rng = np.random.default_rng(7)
    image = rng.random((20, 12))
    got = audio.fingerprint(image)
    for n in (0, 5, 12):
        value = 0
        for plus, minus in audio.rectangles():
            a, b = (sum(image[n + x : n + x + w, y : y + h].sum() for x, y, w, h in part) for part in (plus, minus))
            level = int(np.searchsorted(audio.LEVELS, round((a - b) / (a + b + 1e-9), 6), side="right"))
            value = value << 2 | audio.GRAY[level]
        assert got[n] == value
