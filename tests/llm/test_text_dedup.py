"""Substrings, lines and near copies against plain versions."""

import hashlib
import random
from itertools import combinations

import pytest
from helpers import WORD, awkward, docs, groups

from kairograph.llm import line_dedup, ngram_join, substring_dedup
from kairograph.llm.components import components, contracted


def plain_substrings(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    order = [2**64 if d is None else d for d, _ in rows]
    first = {}
    for d, w in zip(order, words, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (doc, _), d, w in zip(rows, order, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substrings_match_the_plain_version(spark):
    rnd = random.Random(1)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    passage, long = fresh(60), fresh(3000)
    rows = [(5, " ".join(fresh(30) + passage + fresh(20))), (3, " ".join(passage)), (9, "\t".join(fresh(10) + passage[:50] + ["x"] + passage[10:] + fresh(3)))]
    rows += [(11, " ".join(long)), (12, " ".join(long)), (13, " ".join(long[100:2900])), (14, " ".join(passage[:49]))]
    rows += [(20, None), (21, ""), (22, " \n\x0b "), (23, "a b"), (24, "a b"), (3, " ".join(passage)), (5, " ".join(passage)), (None, " ".join(passage)), (None, None)]
    rows += [(30, "ß\xa0x " * 70), (31, "ß\xa0x " * 90), (32, "same " * 400), (33, "same " * 200)]
    for window in (50, 7):
        got = substring_dedup.dedup_substrings(awkward(docs(spark, rows)), window).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_substrings(rows, window)
    assert substring_dedup.dedup_substrings(docs(spark, rows).limit(0)).count() == 0
    kept = {r["doc_id"]: r["kept_text"] for r in substring_dedup.dedup_substrings(docs(spark, rows[:2]), with_text=True).collect()}
    assert kept[3] == rows[1][1] and len(kept[5].split()) == 50


def test_substrings_of_repeated_rows_and_the_largest_id(spark, monkeypatch):
    rnd = random.Random(13)
    passage = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(80))
    rows = [(7, "x " + passage)] * 1000 + [(2**63 - 1, passage + " y"), (None, passage + " z"), (None, "x " + passage), (-(2**63), passage[:300]), (3, passage), (2**63 - 1, passage)]
    for ids in (10**6, 0):
        monkeypatch.setattr(substring_dedup, "BROADCAST_IDS", ids)
        got = substring_dedup.dedup_substrings(docs(spark, rows)).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_substrings(rows, 50)


def test_own_quarters_are_the_least_of_each_window():
    import numpy as np

    q = np.random.default_rng(3).integers(0, 50, 300).astype(np.uint64)
    for span in (1, 2, 7, 39):
        assert substring_dedup.own_quarters(q, span).tolist() == [i + int(q[i : i + span].argmin()) for i in range(len(q) - span + 1)]


def test_lines_spread_over_sites_go(spark):
    rows = [(i, f"own {i}\n  shared line \n\nnear", f"site{i}") for i in range(8)]
    rows += [(8, "shared line\nshared line\nlast", "site0"), (9, None, "site1"), (10, "", "site2"), (11, "only here\nshared line", None)]
    copies = [(100 + i, "copied document\nof two lines", f"site{i}") for i in range(20)]
    seven = [(200 + i, f"b{i}\nalmost", f"site{i}") for i in range(7)]
    df = awkward(docs(spark, rows + copies + seven))
    out = line_dedup.dedup_lines(df, copies_once=True)
    assert out.columns == df.columns and out.count() == df.count()
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[0] == ("own 0\n", 6) and got[8] == ("last", 4) and got[9] == (None, 0) and got[10] == ("", 0) and got[11][0] == "only here"
    assert got[100][0] == "copied document\nof two lines"  # whole copies count once
    assert got[200][0] == "b0\nalmost"
    every = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.dedup_lines(df).collect()}
    assert every == {d: ("", 0) if 100 <= (d or 0) < 120 else v for d, v in got.items()}  # on 20 sites, copied or not
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    report = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(df, report=True).collect()}
    assert report[0] == (4, 2) and report[9] == (0, 0) and report[8] == (3, 2)


def test_lines_match_the_plain_version(spark, monkeypatch):
    rnd = random.Random(14)
    pool = [f"line {k}" for k in range(30)] + ["", " ", "\t"]
    rows = [(k if k % 17 else None, "\n".join(rnd.choice(pool) + rnd.choice(["", "\r", " \t"]) for _ in range(rnd.randrange(1, 6))), rnd.choice(["a", "b", "c", "d", None])) for k in range(60)]
    rows += [(99, "line 1\n" * 50_000 + "own", "a"), (98, None, "b"), rows[3], rows[3], (97, rows[3][1], "z")]
    sites = {}
    for _, text, site in rows:
        for x in (text or "").split("\n"):
            sites.setdefault(x.strip(line_dedup.BLANK), set()).add(site)
    gone = {x for x, v in sites.items() if x and len(v) >= 4}
    want = []
    for d, text, _ in rows:
        left = None if text is None else [x for x in text.split("\n") if x.strip(line_dedup.BLANK) not in gone]
        want.append((d, len(text.split("\n")) if text is not None else 0, len(text.split("\n")) - len(left) if text is not None else 0, None if left is None else "\n".join(left)))
    assert 3 < len(gone) < 28
    for ids in (10**6, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_IDS", ids)
        got = line_dedup.dedup_lines(awkward(docs(spark, rows)), min_sites=4, report=True).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_spread_near_and_far_from_the_threshold(spark):
    rows = [(h, f"s{k}") for h, n in ((1, 1), (2, 19), (3, 20), (4, 21), (5, 500)) for k in range(n) for _ in range(3)]
    got = {r["h"]: r["sites"] for r in line_dedup.boilerplate(spark.createDataFrame(rows, "h long, site string"), 20).collect()}
    assert set(got) == {3, 4, 5} and got[3] == 20 and got[4] == 21 and abs(got[5] - 500) < 40


def plain_jaccard(rows, n=5, t=0.8):
    sets = {}
    for d, text in rows:
        w = WORD.findall((text or "").lower())
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])]
    return groups(pairs, sorted(sets))


def test_near_copies_match_the_plain_version(spark):
    rnd = random.Random(2)
    rows, doc = [], 0
    for size, copies, changes in ((200, 6, 4), (60, 300, 1), (40, 5, 3), (12, 4, 1), (2000, 3, 30)):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randrange(changes + 1)):
                w[rnd.randrange(size)] = f"v{rnd.randrange(10**6)}"
            rows.append((doc, " ".join(w)))
            doc += 1
    rows += [(doc + k, t) for k, t in enumerate(["A b", "a  B", "a b c", None, "", " ", "one"])]
    rnd.shuffle(rows)
    plain = plain_jaccard(rows)
    df = awkward(docs(spark, rows))
    out = ngram_join.jaccard_join(df)
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in out.collect()}
    assert got == plain
    kept = {r["doc_id"] for r in ngram_join.keep_one_of_each(df).collect()}
    assert kept == {root for _, root in plain.values()}


def test_near_copies_at_other_thresholds_and_in_large_groups(spark, monkeypatch):
    rnd = random.Random(12)
    rows = []
    for size, copies, changes in ((40, 60, 12), (30, 8, 3), (300, 5, 40), (9, 6, 2)):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randrange(changes + 1)):
                w[rnd.randrange(size)] = f"v{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    repeated = rows + [rows[0]] * 1000
    monkeypatch.setattr(ngram_join, "BUCKET", 3)  # large buckets, in several pieces
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    for t in (0.5, 0.855):
        plain = plain_jaccard(rows, t=t)
        got = {(r["doc_id"], r["n_links"], r["component_id"]) for r in ngram_join.jaccard_join(docs(spark, repeated), t).collect()}
        assert got == {(d, *v) for d, v in plain.items()}
    assert [ngram_join.shape_for(t) for t in (0.8, 0.5, 0.4)] == [(32, 4), (64, 2), (128, 1)]
    with pytest.raises(ValueError):
        ngram_join.shape_for(0.05)


def test_near_copies_of_one_id_with_several_texts_and_very_long_ones(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "a b c d e f g"), (3, "p q r s t u v"), (4, long), (5, long + " x")]
    got = sorted((tuple(r) for r in ngram_join.jaccard_join(docs(spark, rows)).collect()), key=str)
    assert got == [(1, 1, 1, 1, True), (1, 1, 1, 1, True), (2, 1, 1, 1, False), (3, 1, 1, 1, False), (4, 4, 1, 4, True), (5, 5, 1, 4, False)]
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "p q r s t u v")]
    kept = sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one_of_each(docs(spark, rows)).collect())
    assert kept == [(1, "a b c d e f g"), (2, "p q r s t u v")]


def test_near_copies_without_ids_or_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "a b c d e f g")]
    got = sorted(((r["doc_id"], r["n_links"], r["component_id"], r["kept"]) for r in ngram_join.jaccard_join(docs(spark, rows)).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]
    assert ngram_join.jaccard_join(docs(spark, rows).limit(0)).count() == 0


def test_posterior_bound():
    # Dropping is rare at the threshold and certain far below it.
    for n in ngram_join.STEPS:
        m = ngram_join.least_matches(n)
        assert 0 < m < 0.8 * n
    assert ngram_join.least_matches(128) / 128 > 0.5


def test_edges_of_near_copies_grow_with_members_alone(spark, monkeypatch):
    counts, whole = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda e: counts.append(e.count()) or whole(e))
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*words[: k % 190], f"x{k}", *words[k % 190 + 1 :]])) for k in range(300)]
    out = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()
    assert {(r["component_id"], r["n_links"]) for r in out} == {(0, 299)}
    assert counts and max(counts) <= 2 * len(rows)


def test_contracted_edges_hold_together_what_the_whole_do(spark):
    rnd = random.Random(5)
    for n, m in ((40, 60), (200, 150), (30, 300)):
        edges = spark.createDataFrame([(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)], "node int, root int")
        assert set(components(contracted(edges)).collect()) == set(components(edges).collect())
