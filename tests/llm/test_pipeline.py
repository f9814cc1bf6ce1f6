"""The pipeline against plain versions: each stage on the rows that the one before it kept."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
from helpers import DOC, WORD
from test_packing_and_mixing import one_by_one
from test_text_dedup import plain_jaccard
from tokenizers import Tokenizer

import corpus_pipeline
from kairograph.llm import line_dedup, mixing, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make_tables(spark, folder):
    rnd = random.Random(11)
    words = ["stone", "river", "garden", "window", "yellow", "table", "morning", "market", "paper", "winter"] + [f"noun{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(500):
        w = [rnd.choice(words) for _ in range(rnd.randint(15, 60))]
        toxic = i % 9 == 0
        if toxic:
            w[3] = w[9] = rnd.choice(["idiot", "moron"])
        text = " ".join(w[:8]) + "\n" + " ".join(w[8:]) + ("\nAll rights reserved by the site." if i % 3 == 0 else "")
        rows.append((i, text, rnd.choice(["en", "de"]), f"src{rnd.randrange(12)}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(600 + k, rows[k][1], "en", "src0", 0) for k in range(1, 60)]  # copies
    rows += [(700 + k, rows[k][1] + " tail", "en", "src1", 0) for k in range(1, 40)]
    rows += [(900, None, None, None, None), (901, "", "en", "src2", 0), (902, "word " * 4000, "en", "src3", 20000)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def plain_lines(rows):
    first = {}
    for d, text, _, source, _ in rows:
        if text is not None:
            first[text] = min(first.get(text, (d, source)), (d, source))
    sites = defaultdict(set)
    for text, (_, source) in first.items():
        for line in text.split("\n"):
            sites[line.strip(" ")].add(source)
    common = {x for x, s in sites.items() if x and len(s) >= line_dedup.MIN_SITES}
    return {d: None if text is None else "\n".join(x for x in text.split("\n") if x.strip(" ") not in common) for d, text, *_ in rows}


def plain_mix(rows):
    def topic(text, n):
        return "legal" if "icense" in text else "data" if any(c in "0123456789" for c in text) else "short" if n < 100 else "article" if n < 1000 else "long"

    cell, weight = {}, Counter()
    for d, text, lang, source, _ in rows:
        n = len(WORD.findall(text or ""))
        cell[d] = (source or mixing.NONE, lang or mixing.NONE, topic(text or "", n))
        weight[cell[d]] += n
    factor = dict.fromkeys(weight, 1.0)
    goals = []
    for k, name in enumerate(mixing.TEMPER):
        seen = Counter()
        for c, n in weight.items():
            seen[c[k]] += n
        share = {v: n ** mixing.TEMPER[name] for v, n in seen.items() if n}
        goals.append({v: s / sum(share.values()) * sum(weight.values()) for v, s in share.items()})
    off = [0.0]
    while len(off) <= mixing.MOST_ROUNDS:
        worst = 0.0
        for k, goal in enumerate(goals):
            now = Counter()
            for c, n in weight.items():
                now[c[k]] += n * factor[c]
            worst = max([worst, *(abs(goal[v] / m - 1) for v, m in now.items() if m > 0)])
            factor = {c: f * goal[c[k]] / now[c[k]] if now[c[k]] > 0 else f for c, f in factor.items()}
        off.append(worst)
        if worst <= mixing.TOLERANCE or len(off) - 1 > 2 * mixing.STALL and worst > 0.9 * off[-1 - mixing.STALL]:
            break
    most = max(f for c, f in factor.items() if weight[c])
    odds = {c: min(1.0, f / most) if weight[c] else 1.0 for c, f in factor.items()}
    draw = lambda d: int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:13], 16) / 16**13
    return {d for d, c in cell.items() if draw(d) < odds[c]}


def test_every_stage_and_the_whole(spark, tmp_path):
    folder = str(tmp_path)
    make_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]
    rows = {None: sorted(map(tuple, docs.select(COLUMNS).collect()))}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert docs.columns == COLUMNS
            rows[name] = sorted(map(tuple, docs.collect()))

    judged = toxicity.score_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    rejected = {r["doc_id"] for r in judged.where("predicted = 1").collect()}
    assert {r[0] for r in rows["toxicity"]} == {r[0] for r in rows[None]} - rejected
    assert {i for i in range(500) if i % 9 == 0} <= rejected and not any(i in rejected for i in range(500) if i % 9)

    left = plain_lines(rows["toxicity"])
    assert {r[0]: r[1] for r in rows["line_dedup"]} == left
    notice = lambda stage: any("All rights reserved by the site." in (r[1] or "").split("\n") for r in rows[stage])
    assert notice("toxicity") and not notice("line_dedup")

    groups = plain_jaccard([(r[0], r[1]) for r in rows["line_dedup"]])
    assert {r[0] for r in rows["ngram_jaccard_join"]} == {root for _, root in groups.values()}

    assert {r[0] for r in rows["mixing"]} == plain_mix(rows["ngram_jaccard_join"])

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = []
    for r in rows["mixing"]:
        n = len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1
        lengths += ([n % 1024] if n % 1024 else []) + [1024] * (n // 1024)
    packed = docs.collect()
    assert sorted(r["length"] for r in packed) == sorted(lengths)
    assert len({r["sequence_id"] for r in packed}) == len(one_by_one(lengths, 1024))
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, packed))
