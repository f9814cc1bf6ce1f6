"""Toxicity on held-out rows and disguised words, license forms, WARC round trips."""

import gzip
import math
import random
import re
import textwrap
from itertools import product

from helpers import awkward, docs
from pyspark.sql import functions as F

from kairograph.llm import licenses, toxicity, warc


def corpus(spark, disguise=lambda w: w):
    rnd = random.Random(9)
    plain = ["stone", "river", "garden", "window", "yellow", "table", "morning", "market", "paper", "winter", "summer", "bridge", "letter", "forest", "station"]
    bad = ["idiot", "moron", "loser", "pathetic", "stupid"]
    rows, labels = [], []
    for i in range(700):
        w = [rnd.choice(plain) for _ in range(40)]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(2):
                w[rnd.randrange(40)] = rnd.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + k, " ".join([*plain, disguise(b), *plain])) for k, b in enumerate(bad)]
    rows += [(2000, None), (2001, ""), (2002, "a " * 5000), (None, "stone idiot"), (2003, "!" * 3000), (2004, "zzz" * 4000)]
    return docs(spark, rows), spark.createDataFrame([*labels, (9999, 1, 1), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_scores_of_held_out_and_awkward_rows(spark):
    d, labels = corpus(spark)
    got = toxicity.score_toxicity(awkward(d), labels).collect()
    assert len(got) == d.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 700]
    assert len(held) > 80 and all(r["predicted"] == int(r["doc_id"] % 7 == 0) for r in held)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert by[2000] == by[2001] == by[2002] == by[2003] == 0 and by[None] == 1
    kept = toxicity.reject_toxic(awkward(d), labels)
    assert kept.columns == awkward(d).columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {k for k, v in by.items() if not v}
    assert toxicity.score_toxicity(d.limit(0), labels).count() == 0
    assert toxicity.score_toxicity(d, labels.limit(0)).where("predicted = 1").count() == 0


def test_disguised_words_are_restored(spark):
    d, _ = corpus(spark)
    model = toxicity.language_model(d.where("doc_id < 700"))
    for shown, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("stuuuupid", "stupid"), ("p4th3tic", "pathetic")):
        assert meant in toxicity.restored(f"the {shown} again", model)
    assert toxicity.restored("a plain text, with 12 figures and +1 (456) 555", model) == []


def test_disguised_words_count(spark):
    leet = str.maketrans("oei", "031")
    d, labels = corpus(spark, lambda w: w.translate(leet))
    by = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(d, labels).collect()}
    assert [by[1000 + k] for k in range(5)] == [1] * 5


def test_every_form_of_disguise_is_restored(spark):
    d, _ = corpus(spark)
    model = toxicity.language_model(d.where("doc_id < 700"))
    digits = ("1d107", "57up1d", "$7up1d")
    apart = ("i_d_i_o_t", "i d i o t", "i  d  i  o  t", "i,d,i,o,t", "i/d/i/o/t", "i, d, i, o, t", "i|d|i|o|t", "i+d+i+o+t", "i\u2192d\u2192i\u2192o\u2192t", "i\u00a0d\u00a0i\u00a0o\u00a0t")
    for shown, meant in ((digits[0], "idiot"), (digits[1], "stupid"), (digits[2], "stupid"), *((a, "idiot") for a in apart), ("iddiiott", "idiot"), ("ssttuuppiidd", "stupid"), ("i d i o t  m o r o n", "idiot moron")):
        assert meant in toxicity.restored(f"the {shown} again", model), shown
    assert toxicity.disguised("$h17 now") == ["$h17"] and toxicity.disguised("then d i e now") == ["d i e"]
    assert set(toxicity.restored("a yellow letter in summer", model)) == {"yellow", "letter", "summer"}
    assert toxicity.restored("it cost $500, (456) or 10 20 30 and 1, 2, 3", model) == []


def test_every_form_of_disguise_counts(spark):
    for form in ("_".join, "/".join, "  ".join, lambda w: "".join(c + c for c in w)):
        d, labels = corpus(spark, form)
        by = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(d.where("doc_id < 2000"), labels).collect()}
        assert [by[1000 + k] for k in range(5)] == [1] * 5


def every_path(run, model):
    """The best score of all paths through a lattice, and the texts that reach it, one path after the other."""
    best, texts = -math.inf, set()
    for path in product(*toxicity.lattice(run), [(" ", 0.0)]):
        x = y = 0
        score = 0.0
        for string, cost in path:
            score += cost
            for c in string:
                z = int(toxicity._TABLE[ord(c)])
                if z or y:
                    score, x, y = score + float(model[x, y, z]), y, z
        text = "".join(string for string, _ in path)[:-1]
        if score > best + 1e-9:
            best, texts = score, set()
        if score > best - 1e-9:
            texts.add(text)
    return texts


def test_viterbi_finds_the_best_of_all_paths(spark):
    d, _ = corpus(spark)
    model = toxicity.language_model(d.where("doc_id < 700"))
    rnd = random.Random(15)
    runs = ["1d10t", "m0r0n", "i d i o t", "l.o.s.e.r", "stuuuupid", "$7up1d", "a|d|c|t", "6o6 b", "xx11!!", "i  d i  o"]
    runs += ["".join(rnd.choice("abiost0134$!|. ") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    for run in runs:
        assert toxicity.decode(run, model) in every_path(run, model), run


def test_scores_match_a_plain_scorer(spark):
    d, labels = corpus(spark, "_".join)
    plain = d.select("doc_id", "text")
    model = toxicity.language_model(plain)
    table, w = toxicity.learn(plain, labels, model)
    assert table and all(v >= toxicity.STRONG for v in table.values())
    for r in toxicity.score_toxicity(d, labels).join(d.select("doc_id", "text"), "doc_id").where("doc_id < 40 or doc_id between 1000 and 1999").collect():
        read = re.findall(r"[^\W\d_]+", " ".join([r["text"].lower(), *toxicity.restored(r["text"], model)]))
        hits = [table.get("=" + x, max([table.get("^" + x[:n], 0.0) for n in toxicity.BEGINNINGS if len(x) > n], default=0.0)) for x in set(read)]
        z = w[0] * max(hits, default=0.0) + w[1] * math.log(1 + sum(hits)) + w[2]
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_very_long_runs_end(spark):
    d, labels = corpus(spark)
    rnd = random.Random(16)
    hexes = "".join(rnd.choice("0123456789abcdef") for _ in range(200_000))
    long = docs(spark, [(5000, hexes), (5001, "a b " * 100_000), (5002, "x" * 300_000 + "1"), (5003, "stone " * 50_000 + " ".join("idiot"))])
    by = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(d.unionByName(long), labels).where("doc_id >= 5000").collect()}
    assert by == {5000: 0, 5001: 0, 5002: 0, 5003: 1}


def test_canonical_forms_of_licenses(spark):
    mit = dict(reversed(licenses.KNOWN[:3]))["MIT"]
    rows = [
        (1, mit),
        (2, "MIT LICENCE\n\nCopyright (c) 2020 Somebody\n\n" + mit.split("\n", 2)[2].upper().replace("SUBLICENSE", "sub-license").replace('"AS IS"', "“as is”")),
        (3, "prose\nReleased under the MIT License.\nmore\n * Licensed under CC BY-NC 4.0 *\nAll rights reserved."),
        (4, mit + " and more"),
        (5, None),
        (6, ""),
        (7, "word " * 20000),
        (3, "another text"),
        (None, "All rights reserved"),
    ]
    df = awkward(docs(spark, rows))
    out = licenses.scan_licenses(df).collect()
    assert len(out) == len(rows)
    by = {(r["doc_id"], r["license_id"]): (r["n_notices"], r["notices"]) for r in out}
    assert (1, "MIT") in by and (2, "MIT") in by and (4, None) in by and by[5, None] == (0, None) == by[6, None]
    assert (3, "CC-BY-NC-4.0,MIT,all-rights-reserved") == next((r["n_notices"], r["notices"]) for r in out if r["notices"] and "," in r["notices"]) and by[None, "all-rights-reserved"][0] == 1
    # each row is judged by its own text, whatever its id
    assert sorted((r["n_notices"], r["notices"] or "") for r in out if r["doc_id"] == 3) == [(0, ""), (3, "CC-BY-NC-4.0,MIT,all-rights-reserved")]
    assert {r["doc_id"]: r["blocks"] for r in out}[4] == "MIT" and [r["doc_id"] for r in out if r["blocks"]] == [4]
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    own = spark.createDataFrame([("X", "Only this.")], "license_id string, text string")
    assert [r["license_id"] for r in licenses.scan_licenses(docs(spark, [(1, "ONLY, this")]), own).collect()] == ["X"]


def test_licenses_of_null_ids_repeated_rows_and_many_known(spark, monkeypatch):
    rows = [(None, "All rights reserved."), (None, "plain prose"), (7, "Licensed under the MIT License."), (7, "Licensed under the MIT License."), (8, "x\nAll rights reserved\ny\nall rights reserved")]
    want = sorted([(None, 1, "all-rights-reserved"), (None, 0, None), (7, 1, "MIT"), (7, 1, "MIT"), (8, 2, "all-rights-reserved")], key=str)
    for most in (10_000, 3):
        monkeypatch.setattr(licenses, "BROADCAST_KNOWN", most)
        got = licenses.scan_licenses(docs(spark, rows)).select("doc_id", "n_notices", "notices").collect()
        assert sorted(map(tuple, got), key=str) == want


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_whole_texts_wordings_and_copyright_lines(spark):
    mit = dict(reversed(licenses.KNOWN[:3]))["MIT"]
    narrow = lambda t: "\n".join(textwrap.fill(x, 30) for x in t.split("\n\n"))
    whole = [(f"{line}\n\n{mit}", "MIT") for line in ("Copyright Jane Doe 2020", "Copyright: 2020 X", "copyright jane doe, 2020", "Copyright by Jane Doe", "Copyright The Regents of X", "Copyright 2020", "COPYRIGHT JANE DOE")]
    whole += [("BSD 3-Clause License\n\nCopyright Jane Doe\nAll rights reserved.\n\n" + BSD, "BSD-3-Clause"), (narrow(BSD), "BSD-3-Clause"), (narrow(BSD).upper(), "BSD-3-Clause"), ("\n".join(x for x in BSD.split("\n\n") if x[0] != "3"), "BSD-2-Clause"), (BSD + " And more.", None)]
    lines = ["Licensed under the BSD 3-Clause License.", "Released under CC BY 4.0.", "// SPDX-License-Identifier: Apache-2.0", "Distributed under the terms of the GNU General Public License v3.0 or later", "License: MPL-2.0", "This project is licensed under the MIT License", "Published under Creative Commons Attribution-ShareAlike 4.0", "# SPDX-License-Identifier: LGPL-2.1-only", "This is not licensed under the MIT License", "MIT"]
    named = ["BSD-3-Clause", "CC-BY-4.0", "Apache-2.0", "GPL-3.0", "MPL-2.0", "MIT", "CC-BY-SA-4.0", "LGPL-2.1", None, None]
    rows = [(k, t) for k, (t, _) in enumerate(whole)] + [(100 + k, f"prose\n{x}\nprose") for k, x in enumerate(lines)] + [(200 + k, x) for k, x in enumerate(lines)]
    by = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert [by[k]["license_id"] for k in range(len(whole))] == [name for _, name in whole]
    assert [by[100 + k]["notices"] for k in range(len(lines))] == named
    assert [by[200 + k]["license_id"] for k in range(len(lines))] == named
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"} <= {name for name, _ in licenses.WHOLE}


PAGES = [
    (1, "http://a/x", '<html lang="de"><head><title>T &amp; <b>U</b></title><script>var t="</p>";</script></head><body><p>One&nbsp;two</p><!-- no --><p>three<br>four &lt;x&gt;</p><a href="/l?a=1&amp;b=2">link</a></body></html>'),
    (2, None, None),
    (3, "http://a/y", ""),
    (4, "http://a/z", "plain\r\n\r\nWARC/1.1 is not a record é" + "x" * 50000),
    (1, "http://a/x", '<html lang="de"></html>'),
]


def test_derived_records_link_to_their_response(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"block": F.lit(1), "refers_to": F.lit("z"), "links": F.lit(2)})
    out = warc.derive(warc.responses_of_pages(pages)).cache()
    assert out.count() == 2 * len(PAGES)
    own = [r for r in out.collect() if r["page_id"] == 1 and "three" in r["block"] or r["page_id"] == 1 and "T & U" in r["block"]]
    meta, text = sorted(own, key=lambda r: r["warc_type"], reverse=True)
    assert text["block"] == "T & U\nOne two\nthree\nfour <x>\nlink"
    assert "title: T & U\r\nlanguage: de\r\n" in meta["block"] and "outlink: /l?a=1&b=2 L a/@href\r\n" in meta["block"] and "outlinks: 1" in meta["block"]
    assert meta["refers_to"] == text["refers_to"] != meta["record_id"] != text["record_id"]
    assert text["source_digest"] in meta["block"] and text["source_headers"].startswith("HTTP/1.1 200 OK\r\nContent-Type: text/html")
    empty = [r for r in out.collect() if r["page_id"] in (2, 3) and r["warc_type"] == "conversion"]
    assert [r["content_length"] for r in empty] == [0, 0]
    assert warc.derive(warc.responses_of_pages(pages.limit(0))).count() == 0


def test_any_quotes_and_any_reference(spark):
    html = "<html class=x lang='de'><title>It&#8217;s &#x27;caf&eacute;&#x27; &amp;#8217; &#128; &#0; &unknown; &#x1F600; &copy 2020 &notin;</title><a href='/x?a=1&amp;b=2&copy=3'>1</a><a class=b href=/y>2</a><a title=\"href=/no\" href = \"/z&#x26;lt;\">3</a><a data-href='/no'>4</a><A title=it's HREF=/w>5</A><a href=\"it's\">6</a><p>A&#x2014;B&Omega;&#38;lt;&lt;"
    pages = spark.createDataFrame([(1, "u", html), (2, "v", "<html lang=fr><a href=q>"), (3, "w", '<html xml:lang="it">'), (4, "x", "<a " + "word " * 20000 + "&" * 1000)], "page_id long, url string, html string")
    by = {(r["page_id"], r["warc_type"]): r["block"] for r in warc.derive(warc.responses_of_pages(pages)).collect()}
    meta, text = by[1, "metadata"], by[1, "conversion"]
    title = "It\u2019s 'caf\u00e9' &#8217; \u20ac \ufffd &unknown; \U0001f600 &copy 2020 \u2209"
    assert meta.startswith(f"title: {title}\r\nlanguage: de\r\n")
    assert [x[9:].split(" L ")[0] for x in meta.split("\r\n") if x.startswith("outlink: ")] == ["/x?a=1&b=2&copy=3", "/y", "/z&lt;", "/w", "it's"] and "outlinks: 5\r\n" in meta
    assert text.startswith(title) and text.endswith("A\u2014B\u03a9&lt;<")
    assert "language: fr\r\n" in by[2, "metadata"] and "outlink: q L" in by[2, "metadata"] and "language: it\r\n" in by[3, "metadata"] and "outlinks: 0" in by[4, "metadata"]


def test_hidden_links_line_ends_and_missing_fields(spark, tmp_path):
    html = "<!-- <a href='/no'> --><script>'<a href=\"/no2\">'</script><title>a&#13;&#10;b</title><a href='/x\r\nforged: 1'>l</a><a href=/y&#10;z>m</a>"
    rows = [(None, "http://a\r\nforged: 2", None, None, html, 1, 2, 3), (None, "http://b", None, None, "other", 4, 5, 6), ("<urn:uuid:1>", None, "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\n", None, 7, 8, 9)]
    r = spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, http_headers string, payload string, k int, _digest int, BLOCK int")
    out = warc.derive(r)
    assert out.columns == ["k", "_digest", *warc.RECORD]
    got = out.collect()
    assert len({x["record_id"] for x in got}) == 6 and {(x["k"], x["_digest"]) for x in got} == {(1, 2), (4, 5), (7, 8)}
    meta = next(x for x in got if x["k"] == 1 and x["warc_type"] == "metadata")
    assert meta["block"].split("\r\n")[0] == "title: a b" and [x for x in meta["block"].split("\r\n") if x.startswith("outlink: ")] == ["outlink: /x forged: 1 L a/@href", "outlink: /y z L a/@href"]
    warc.write_warc(out.select(*warc.RECORD), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(back) == 6 and all(x["complete"] for x in back) and {x["target_uri"] for x in back} == {"http://a forged: 2", "http://b", None}
    assert sorted(x["source_headers"] or "" for x in back) == [""] * 4 + ["HTTP/1.1 200 OK\r\n"] * 2


def test_responses_of_a_crawl(spark, tmp_path):
    def record(kind, block, name):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:uuid:{name}>\r\nWARC-Target-URI: http://{name}/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: {len(block.encode())}\r\n\r\n{block}\r\n\r\n"

    records = [record("warcinfo", "software: x", "i"), record("request", "GET / HTTP/1.1\r\n\r\n", "q"), record("response", "HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>one\r\n\r\ntwo é", "a"), record("response", "HTTP/1.1 204 No Content\r\n\r\n", "b")]
    (tmp_path / "c.warc.gz").write_bytes(b"".join(gzip.compress(x.encode()) for x in records))
    got = {x["target_uri"]: x for x in warc.read_responses(spark, str(tmp_path), "WARC/1.0").collect()}
    assert set(got) == {"http://a/", "http://b/"} and got["http://a/"]["payload"] == "<p>one\r\n\r\ntwo é" and got["http://b/"]["payload"] == ""
    assert got["http://a/"]["http_headers"] == "HTTP/1.1 200 OK\r\nX: y\r\n" and got["http://a/"]["record_id"] == "<urn:uuid:a>"
    out = warc.derive(warc.read_responses(spark, str(tmp_path), "WARC/1.0")).where("warc_type = 'conversion'").collect()
    assert {(x["refers_to"], x["block"]) for x in out} == {("<urn:uuid:a>", "one\ntwo é"), ("<urn:uuid:b>", "")}


def test_records_survive_files(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    out = warc.derive(warc.responses_of_pages(pages)).select(*warc.RECORD)
    warc.write_warc(out, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert back.where("not complete").count() == 0
    assert sorted(map(tuple, back.select(*warc.RECORD).collect()), key=str) == sorted(map(tuple, out.collect()), key=str)


def test_tags_read_once_are_the_same_tags():
    import re
    from itertools import product

    names = re.findall(r"\w+", warc.BREAKING.partition("(address")[2].join(["address", ""]).partition(")")[0])
    assert len(names) == 37
    words = [*names, *[n + "x" for n in names], *[n[:-1] for n in names], "script", "style", "noscript", "template", "!--"]
    text = " ".join(a + (w.upper() if k else w) + b for w, a, b, k in product(words, ("<", "</", "< ", ""), (">", " a='1'>", "-->", "/", "\n>"), (0, 1)))
    for old, new in ((warc.HIDDEN, warc._HIDDEN_ONCE), (warc.BREAKING, warc._BREAKING_ONCE)):
        spans = [m.span() for m in re.finditer(old, text)]
        assert spans and spans == [m.span() for m in re.finditer(new, text)]
