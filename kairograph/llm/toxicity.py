"""Toxicity by a noisy channel: deobfuscate, then score.

1. A character trigram model is counted over all documents (64 symbols, so at most 64^3 counts).
2. Runs that look disguised (letters mixed with digits or signs, letters held down or doubled, letters set
   apart by any sign or space) become lattices: every character may stand for itself or for letters it
   imitates, a repeated letter may be one or two, a separator inside a spaced word may be nothing. Viterbi
   picks the restored text under the model. Plain words have one path and stay; figures without any letter
   are figures.
3. Restored and plain words are scored. Evidence of words and of word beginnings comes from labelled
   texts; a document's score is a logistic function of the strength and number of its evidence.

Python scores text in batches; what it holds is bounded: the trigram table, the evidence table
(significant words of at most ``TRAINING_ROWS`` texts) and a word memory of ``MEMORY`` entries. Decoding takes time in
proportion to the length of a run.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import cut, in_worker, pick, release, ship

#: Rows of labelled text the evidence is learnt from at most: the smallest hashes of ``doc_id``.
TRAINING_ROWS = 20_000
#: Beginnings of words that count as evidence, in letters.
BEGINNINGS = (3, 4, 5, 6)
#: Evidence must be this strong (log odds less one standard error), and its log-likelihood ratio must
#: exceed what the best of all features would reach by chance, about twice the logarithm of their number.
STRONG = 1.5
MEMORY = 200_000
SYMBOLS = 64

# Signs and digits and the letters they imitate.
IMITATED = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "<": "c",
    "€": "e",
    "£": "l",
    "¡": "i",
}
#: Log probabilities of the channel: a letter as itself, an imitation, a sign or digit as itself,
#: a repeat that adds nothing, a separator that is nothing.
KEPT, IMITATES, LITERAL, HELD, APART = 0.0, -1.5, -9.0, -0.5, -0.5

_SIGNS = "".join(re.escape(c) for c in IMITATED)
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(rf"(?<![\w{_SIGNS}])[^\W\d_]*+[\d{_SIGNS}][\w{_SIGNS}]*")
_HELD = re.compile(r"([^\W\d_])\1\1")
_AROUND = re.compile(r"\w+")
_DOUBLED = re.compile(r"(.)\1")
#: One character of a word set apart, and what may lie between two: spaces, or other signs with spaces around them.
_ONE = rf"(?:[^\W_]|[{_SIGNS}])"
_GAP = rf"(?:\s{{1,4}}|\s{{0,2}}(?:[^\w\s{_SIGNS}]|_){{1,3}}\s{{0,2}})"
_WIDEST = 8
_APART = re.compile(rf"(?<![^\W_])(?<![{_SIGNS}]){_ONE}(?:{_GAP}{_ONE}(?!{_ONE})){{2,}}")
#: Letters set apart by one of the signs that also imitate letters.
_APART_BY_SIGN = re.compile(rf"[^\W_]([{_SIGNS}])[^\W_](?:\1[^\W_])+")
#: Signs that imitate a letter even in a run without letters; those of money do not lead it.
_STANDS_ALONE, _MONEY = "@$!|€£¡", "$€£"


def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 for anything but letters, 1 to 26 for a to z, else by remainder."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x250):
        s = chr(c).lower()
        if s.isalpha():
            table[c] = ord(s) - 96 if "a" <= s <= "z" else 27 + ord(s[0]) % (SYMBOLS - 27)
    rest = np.arange(0x250, 0x110000)
    table[rest] = 27 + rest % (SYMBOLS - 27)
    table[0x2000:0x2070] = table[0x3000:0x3004] = 0
    return table


_TABLE = _symbols()
#: 1 for letters, 2 for digits and imitating signs, 0 for the rest.
_KIND = np.minimum(_TABLE, 1)
_KIND[[ord(c) for c in IMITATED]] = _KIND[48:58] = 2
#: Letters, digits and imitating signs, which are not separators.
_FULL = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
_FULL[[ord(c) for c in IMITATED]] = True
_ALONE = np.zeros(0x110000, dtype=bool)
_ALONE[[ord(c) for c in _STANDS_ALONE]] = True


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return _TABLE[points]


def _trigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for b in batches:
        for text in b.column(0):
            s = encode("  " + text.as_py() + " ").astype(np.int32)
            s = s[np.concatenate(([True], (s[1:] > 0) | (s[:-1] > 0)))]  # gaps as one
            if len(s) > 2:
                code = s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:]
                total += np.bincount(code, minlength=SYMBOLS**3) if len(code) > 20_000 else 0
                if len(code) <= 20_000:
                    np.add.at(total, code, 1)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [a, b, c] of symbol c after a, b, from all texts: trigrams interpolated with
    bigrams and single symbols. At most 64^3 counts reach the driver, whatever the corpus holds."""
    counts = docs.where("text is not null").select("text").mapInArrow(in_worker("toxicity", _trigrams), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    n = np.zeros(SYMBOLS**3)
    for r in counts.collect():
        n[r["code"]] = r["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
    two = (n.sum(0) + 5 * one) / (n.sum((0, 2))[:, None] + 5)
    return np.log((n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5)).astype(np.float32)


def lattice(run: str) -> list[list[tuple[str, float]]]:
    """For each place of a disguised run the strings it may stand for, with their channel cost."""
    run = run.lower()
    apart = bool(_APART.fullmatch(run) or _APART_BY_SIGN.fullmatch(run))
    gap = lambda c: apart and not c.isalnum() and c not in IMITATED
    least = min((len(g) for g in re.findall(_GAP, run)), default=0) if apart else 0
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(run):
        c, n = run[i], 1
        while i + n < len(run) and (run[i + n] == c or gap(c) and gap(run[i + n])):
            n += 1
        here = IMITATED.get(c, "")
        if gap(c):  # wider than others, it may part two words
            out.append([("", APART), (" ", APART if n > least else LITERAL)])
        elif c.isalpha():
            out.append([(c, KEPT)] if n == 1 else [(c + c, KEPT), (c, IMITATES)] if n == 2 else [(c, HELD), (c + c, HELD)])
        elif here:
            out.append([(c, LITERAL)] + [(h, IMITATES) for h in here] + ([(h + h, IMITATES + HELD) for h in here] if n > 1 else []) + ([("", APART)] if apart and i and not c.isdigit() else []))
        else:
            out.append([(c, LITERAL)])
        i += n
    return out


def decode(run: str, model: np.ndarray) -> str:
    """The most probable text of a run under the model, by Viterbi over the last two symbols."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for place in lattice(run) + [[(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for string, cost in place:
                x, y, s = a, b, score + cost
                for c in string:
                    z = int(_TABLE[ord(c)])
                    if z or y:
                        s += float(model[x, y, z])
                        x, y = y, z
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, (string, path))
        states = after
    path = max(states.values(), key=lambda v: v[0])[1]
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))[:-1]


def restorable(run: str) -> bool:
    """Whether a run may be a word: it has a letter, or a sign that stands for one and is no price."""
    return any(map(str.isalpha, run)) or any(c in _STANDS_ALONE for c in run.lstrip(_MONEY)) or sum(c in _MONEY for c in run) > 1


def disguised(text: str, plain: set[str] | None = None) -> list[str]:
    """Runs that may be obfuscated words; ``plain``: the words of the text, if they are at hand. Array operations
    tell which kinds a text has at all."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    kind = _KIND[points]
    runs: list[str] = []
    if ((kind[1:] + kind[:-1]) == 3).any() or (_ALONE[points[:-1]] & (kind[1:] == 2)).any() or (_ALONE[points[1:]] & (kind[:-1] == 2)).any():
        runs += [r for m in _MIXED.finditer(text) if len(r := m.group().rstrip("!|+(<")) > 2 and restorable(r) and not r.isalpha()]
    if ((points[1:] == points[:-1]) & (kind[1:] == 1)).any() or plain is None:
        runs += [w for w in (_WORD.findall(text.lower()) if plain is None else plain) if _DOUBLED.search(w)]
    if len(points) > 2 and ((points[2:] == points[1:-1]) & (points[1:-1] == points[:-2]) & (kind[2:] == 1)).any():
        held = {m.start() for m in _HELD.finditer(text)}
        runs += [m.group() for m in _AROUND.finditer(text) if any(m.start() <= h < m.end() for h in held)] if len(held) < 8 else [m.group() for m in _AROUND.finditer(text) if _HELD.search(m.group())]
    if len(points) > 4:
        full = np.zeros(len(points) + 2, dtype=bool)
        full[1:-1] = _FULL[points]
        alone = np.flatnonzero(full[1:-1] & ~full[:-2] & ~full[2:])
        if (alone[2:] - alone[:-2] <= 2 * _WIDEST).any():
            runs += [r for m in _APART.finditer(text) if restorable(r := m.group())]
    return runs


def restored(text: str, model: np.ndarray, memory: dict[str, str] | None = None, plain: set[str] | None = None) -> list[str]:
    """Restored strings of the disguised runs of a text; the rest of it reads as it is."""
    memory = {} if memory is None else memory
    out = []
    for r in set(disguised(text, plain)):
        if r not in memory:
            if len(memory) >= MEMORY // 4:
                memory.clear()
            memory[r] = decode(r, model)
        out.append(memory[r])
    return out


def words(text: str | None, model: np.ndarray, memory: dict[str, str] | None = None) -> set[str]:
    if not text:
        return set()
    found = set(_WORD.findall(text.lower()))
    for r in restored(text, model, memory, found):
        found.update(_WORD.findall(r))
    return found


def features(word: str) -> list[str]:
    return ["=" + word] + ["^" + word[:n] for n in BEGINNINGS if len(word) > n]


def _counts(model: np.ndarray, known: set[str] | None):
    """Texts of each label that hold a word; or, given the words that count by themselves, that hold a
    beginning in any other word, lest a beginning count for one word alone."""
    of = (lambda w: ["=" + w]) if known is None else (lambda w: features(w)[1:] if "=" + w not in known else [])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[label].update({f for w in words(text.as_py(), model) for f in of(w)})
        for label, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([label] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["feature", "label", "n"])

    return run


class Evidence:
    """Log odds of a word: its own, else those of its strongest significant beginning, else 0."""

    def __init__(self, table: dict[str, float]):
        self.table, self.memory = table, {}

    def of(self, word: str) -> float:
        v = self.memory.get(word)
        if v is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            whole, *parts = features(word)
            v = self.table.get(whole)
            if v is None:
                v = max((self.table.get(f, 0.0) for f in parts), default=0.0)
            self.memory[word] = v
        return v

    def summary(self, found: set[str]) -> tuple[float, float]:
        hits = [v for v in map(self.of, found) if v]
        return max(hits, default=0.0), math.log1p(sum(hits))


def _summaries(model: np.ndarray, table: dict[str, float], columns: list[str], kinds: list):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, memory = Evidence(table), {}
        for b in batches:
            found = [evidence.summary(words(t.as_py(), model, memory)) for t in b.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*(b.column(k).cast(kind) for k, kind in enumerate(kinds)), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=[*columns, "strongest", "amount"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(x) * np.diag([1.0] * (len(w) - 1) + [1e-6])
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * np.r_[w[:-1], 0]), -5, 5)
    return w


def significant(texts: DataFrame, model: np.ndarray, known: set[str] | None, bad: int, good: int) -> dict[str, float]:
    """Feature -> log odds, of all features of ``_counts`` that tell the labels apart."""
    n = texts.mapInArrow(in_worker("toxicity", _counts(model, known)), "feature string, label int, n long").groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (F.lit(bad) + 1)) - F.log((F.col("q") + 0.5) / (F.lit(good) + 1)) - F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    # Log-likelihood ratio of seeing p and q against one rate for both.
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    both = F.col("p") + F.col("q")
    ratio = 2 * (part(F.col("p"), both * bad / (bad + good)) + part(F.col("q"), both * good / (bad + good)))
    n = cut(n, "features")
    least = 2 * math.log(max(n.count(), 2))
    rows = n.select("feature", odds.alias("odds"), ratio.alias("ratio")).where((F.col("ratio") >= least) & (F.col("odds") >= STRONG)).collect()
    release(n)
    return {r["feature"]: r["odds"] for r in rows}


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray, training_rows: int = TRAINING_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Evidence table and weights from rows whose crc32(doc_id) modulo 5 is not 0: at most
    ``training_rows`` of them, those with the smallest hashes. Equal texts count once."""
    marked = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    chosen = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    texts = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("k")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    texts = cut(texts.select("toxic", "text"), "labelled")
    by = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    bad, good = by.get(1, 0), by.get(0, 0)
    if not bad or not good:
        return {}, np.array([0.0, 0.0, math.log((bad + 0.5) / (good + 1.5))])
    table = significant(texts, model, None, bad, good)
    table |= significant(texts, model, set(table), bad, good)
    seen = texts.select("toxic", "text").mapInArrow(in_worker("toxicity", _summaries(model, table, ["toxic"], [pa.int32()])), "toxic int, strongest double, amount double").toPandas()
    release(texts)
    return table, fit_logistic(seen[["strongest", "amount"]].to_numpy(), seen["toxic"].to_numpy(dtype=float))


def score_toxicity(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    Null and empty texts get the score of a text without evidence. Labels of documents that are not there,
    null labels and labels other than 0 and 1 are ignored; of several labels of a document the larger holds.
    Without labels of both kinds the score is the base rate, and 1/4 without any. An empty table gives an empty result. Repeated
    rows are scored alike. Other columns are not looked at."""
    ship(docs.sparkSession)
    docs = pick(docs, "doc_id", "text")
    model = language_model(docs)
    table, w = learn(docs, labels, model, training_rows)
    scored = docs.mapInArrow(in_worker("toxicity", _summaries(model, table, ["doc_id"], [pa.int64()])), "doc_id long, strongest double, amount double")
    z = F.lit(float(w[0])) * F.col("strongest") + F.lit(float(w[1])) * F.col("amount") + F.lit(float(w[2]))
    score = 1 / (1 + F.exp(-z))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``score_toxicity`` would not predict as toxic, with all their columns."""
    ship(docs.sparkSession)
    plain = pick(docs, "doc_id", "text")
    model = language_model(plain)
    table, w = learn(plain, labels, model, training_rows)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, memory = Evidence(table), {}
        for b in batches:
            found = (evidence.summary(words(t.as_py(), model, memory)) for t in b.column(at))
            yield b.filter(pa.array([1 / (1 + math.exp(-(w[0] * x + w[1] * y + w[2]))) < 0.5 for x, y in found], pa.bool_()))

    named = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    return named.mapInArrow(in_worker("toxicity", run), named.schema).toDF(*docs.columns)
