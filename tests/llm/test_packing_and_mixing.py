"""Packing against one-by-one best fit, tokenizer round trips, raking."""

import random
import struct
import warnings
import zlib
from collections import Counter

import public_tokenizers
import pytest
from helpers import awkward, docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kairograph.llm import mixing, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_is_that_of_one_by_one_best_fit():
    for seed in range(120):
        rnd = random.Random(seed)
        capacity = rnd.choice([1, 10, 17, 64])
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 150))]
        filled, spans = Counter(), {}
        for length, a, b, first, at in packing.best_fit_plan(Counter(lengths), capacity):
            for k in range(b - a):
                filled[first + k] += length
                spans.setdefault(first + k, []).append((at, length))
        assert sorted(capacity - v for v in filled.values()) == one_by_one(lengths, capacity)
        for parts in spans.values():
            end = 0
            for at, length in sorted(parts):
                assert at == end
                end += length


def test_tightest_open_capacity():
    tree = packing.CapacityTree(20)
    for c in (3, 7, 20):
        tree.put(c, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 7, 8, 20)] == [3, 3, 7, 7, 20, 20]
    tree.put(20, 0)
    assert tree.tightest(8) is None


TEXTS = [None, "", " ", "a   b\n\n c\t\t", "it's I'LL <|endoftext|> x", "x .y, z.", 'he said "foo", and', "é, ñ. ²,³ \x85\xa0", "word " * 3000, "a" * 4000, "...,,. .", "a\x00b, c", "\n a", "a \n", "3.14, (2.0)."]


def test_pieces_carry_the_tokenizers_ids(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "null id")]
    got = packing.pack(awkward(docs(spark, rows)), with_ids=True).collect()
    want = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024
        cuts = [0] * (head > 0) + list(range(head, len(ids), 1024))
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            part = ids[a:b]
            want[doc, k, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), tuple(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 1024
    assert len(bins) == len(one_by_one([r["length"] for r in got], 1024))
    assert packing.pack(docs(spark, rows).limit(0)).count() == 0


def test_raked_shares_meet_their_targets(spark):
    rnd = random.Random(8)
    cells = [(s, lang, t, rnd.randint(1, 1000)) for s in "abc" for lang in ("x", "y") for t in "pq"] + [("a", "x", "empty", 0)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    goal = {"source": spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0), ("none", 9.0)], "v string, share double")}
    out = mixing.rake(df, goal, rounds=25).collect()
    weight = lambda **k: sum(r["tokens"] * r["factor"] for r in out if all(r[a] == b for a, b in k.items()))
    assert [round(weight(source=s) / weight(), 6) for s in "abc"] == [0.5, 0.3, 0.2]
    mass = {v: sum(c[3] for c in cells if c[1] == v) ** mixing.TEMPER["lang"] for v in "xy"}
    assert round(weight(lang="x") / weight(), 6) == round(mass["x"] / sum(mass.values()), 6)


def test_targets_are_met_or_reported(spark):
    # sources tied to a language converge slowly, contradicting targets not at all
    cells = [("a", "x", "p", 900), ("a", "y", "p", 90), ("b", "y", "p", 700), ("b", "x", "p", 70), ("c", "x", "q", 50), ("c", "y", "q", 5)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    share = lambda rows: spark.createDataFrame(rows, "v string, share double")
    goal = {"source": share([("a", 0.45), ("b", 0.5), ("c", 0.05)]), "lang": share([("x", 0.6), ("y", 0.4)]), "topic": share([("p", 0.95), ("q", 0.05)])}
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        out = mixing.rake(df, goal).collect()
    total = sum(r["tokens"] * r["factor"] for r in out)
    for column, value, want in (("source", "a", 0.45), ("lang", "y", 0.4), ("topic", "q", 0.05)):
        assert abs(sum(r["tokens"] * r["factor"] for r in out if r[column] == value) / total - want) < 1e-9
    bad = {**goal, "topic": share([("p", 0.5), ("q", 0.5)])}
    with pytest.warns(UserWarning, match="marginals are not met after 4 rounds"):
        mixing.rake(df, bad, rounds=4)


def test_mixing_handles_awkward_rows(spark):
    rows = [(i, "word " * (i % 7 + 1), f"s{i % 3}") for i in range(200)] + [(500, None, None), (501, "", "s0"), (1, "word word", "s1"), (None, "x y", "s2"), (502, "word " * 300_000, "s1")]
    df = awkward(docs(spark, rows).drop("tokens"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # so few rows do not allow all shares
        report, kept = mixing.mix(df, report=True, rounds=3).cache(), mixing.mix(df, rounds=3).cache()
    assert report.count() == len(rows) and report.where("probability < 0 or probability > 1 or probability is null").count() == 0
    assert report.agg(F.max("probability")).first()[0] == 1.0
    assert kept.columns == df.columns
    assert Counter(r[0] for r in kept.select("doc_id").collect()) == Counter(r[0] for r in report.where("kept").select("doc_id").collect())
    assert mixing.mix(df.limit(0)).count() == 0
    shares = spark.range(20000).select(mixing.draw(F.col("id")).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(shares[0] - 0.5) < 0.01 and shares[1] >= 0 and shares[2] < 1


def test_rounds_over_few_cells_are_one_job(spark, monkeypatch):
    rnd = random.Random(4)
    cells = [(s, lang, t, rnd.choice([0, 7, rnd.randint(1, 900)])) for s in "abcd" for lang in "xyz" for t in "pq" if rnd.random() < 0.8] + [("e", None, "p", 5)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    goal = {"lang": spark.createDataFrame([("x", 5.0), ("y", 3.0), ("none", 9.0)], "v string, share double")}
    written, whole = [], mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda d, label: written.append(label) or whole(d, label))
    out = []
    for most in (100_000, 0):  # all in one row, and as a distributed table
        monkeypatch.setattr(mixing, "BROADCAST_CELLS", most)
        out.append({tuple(r)[:4]: r["factor"] for r in mixing.rake(df, goal, rounds=4).collect()})
        assert most == 0 or len(written) <= 6
    assert out[0].keys() == out[1].keys() and all(abs(out[0][k] / out[1][k] - 1) < 1e-12 for k in out[1])
