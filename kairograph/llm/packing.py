"""Best-fit packing of token sequences.

Best-fit decreasing takes pieces from long to short and puts each into the open bin with
the least remaining room that still holds it. Pieces of one length are interchangeable, so
the driver needs only the histogram of lengths (at most ``capacity`` entries, whatever the
corpus holds): a segment tree over remaining capacities finds the tightest open class of bins
in logarithmic time, and a whole run of equal pieces moves at once. The result is a table
of rank intervals, and every piece finds its bin by its rank among pieces of its length.
The packing is exactly that of the one-by-one algorithm.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairograph.llm.common import cut, in_worker, pick, scratch, ship

CAPACITY = 1024
END_ID = 2
#: Chunks remembered by each Python worker; a full memory is emptied, so it is bounded.
MEMORY = 400_000
#: The plan table is broadcast up to this many rows (five numbers each), else joined by shuffle.
BROADCAST_ROWS = 100_000
#: Pieces that one task ranks at most, on average: the ranks of a length are dealt over salts.
RANKED_ROWS = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_IDS = f"{PIECES}, ids array<int>"


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf is set where bins are open."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(capacity + 1, 2).bit_length()
        self.count = [0] * (2 * self.leaves)

    def put(self, at: int, bins: int) -> None:
        i = at + self.leaves
        self.count[i] = bins
        while i > 1:
            i >>= 1
            self.count[i] = self.count[2 * i] + self.count[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity >= need that has an open bin."""
        i = need + self.leaves
        if self.count[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, rank from, rank to, first sequence, offset): the pieces of this length with
    these ranks go one each into successive sequences from the first, at this offset."""
    tree, opened = CapacityTree(capacity), {}
    plan, bins = [], 0

    def add(room: int, first: int, n: int) -> None:
        runs = opened.setdefault(room, deque())
        runs.append((first, n))
        tree.put(room, tree.count[room + tree.leaves] + n)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                # One by one, a fresh bin takes further equal pieces while it is the tightest.
                each = capacity // length
                full, rest = divmod(left, each)
                for first, n, deep in ((bins, full, each), (bins + full, int(rest > 0), rest)):
                    if n:
                        for k in range(deep):
                            plan.append((length, rank, rank + n, first, k * length))
                            rank += n
                        if capacity - deep * length:
                            add(capacity - deep * length, first, n)
                bins += full + int(rest > 0)
                break
            first, n = opened[room].popleft()
            # A bin that took a piece is then the tightest until it holds no further one.
            each = room // length
            took, deep = (min(n, left // each), each) if left >= each else (1, left)
            if took < n:
                opened[room].appendleft((first + took, n - took))
            tree.put(room, tree.count[room + tree.leaves] - took)
            for k in range(deep):
                plan.append((length, rank, rank + took, first, capacity - room + k * length))
                rank += took
            left -= took * deep
            if room - deep * length:
                add(room - deep * length, first, took)
    return plan


class _Memory(dict):
    """Chunk of text -> its ids as little-endian unsigned 32-bit bytes, or None for a chunk that does
    not end in a letter or digit, after which the quick split of ``encoder`` may be wrong."""

    def __init__(self, path: str, find):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.find, self.known = Tokenizer.from_file(path), find, {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        # Byte-level vocabularies write each byte as a printable character.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [c for c in range(256) if c not in set(shown)]
        self.letters = {c: c for c in shown} | {c: 256 + k for k, c in enumerate(hidden)}
        self.space = chr(self.letters[32])
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size() + len(self.special))]

    def merged(self, chunk: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merge(chunk.encode().decode("latin-1").translate(self.letters))])

    def merged_word(self, chunk: str) -> bytes:
        """ASCII letters after a space or nothing, of which only the space is written otherwise."""
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merge(chunk.replace(" ", self.space))])

    def remembered(self, chunk: str) -> bytes:
        ids = self.known.get(chunk)
        if ids is None:
            ids = self.merged(chunk)
            if len(chunk) <= 64:
                if len(self.known) >= MEMORY // 4:
                    self.known.clear()
                self.known[chunk] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes | None:
        if chunk.removeprefix(" ").isalpha():  # one part of the pattern
            ids = self.merged_word(chunk) if chunk.isascii() else self.merged(chunk)
        else:
            safe = chunk[-1:].isalnum() or chunk in (",", ".")
            parts = self.find(chunk) if safe else ()
            ids = None if not safe else self.merged(chunk) if len(parts) == 1 else b"".join(map(self.remembered, parts))
        if len(chunk) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[chunk] = ids
        return ids


def encoder(path: str, pattern: str):
    """text -> ids as bytes. The tokenizer splits a text by ``pattern`` before it merges, so the ids of a
    text are those of its chunks. Chunks always part before a space between two others and before a comma
    or full stop that follows a letter or digit, so a text is split there by plain replacement, and by the
    pattern around a chunk that rules that out. Letters, after one space or none, are one chunk of the pattern. A text with the string
    of a special token goes whole."""
    memories = scratch("packing", dict)
    if (path, pattern) not in memories:
        memories[path, pattern] = _Memory(path, regex.compile(pattern).findall)
    memory = memories[path, pattern]

    def encode(text: str) -> bytes:
        if any(s in text for s in memory.special):
            return b"".join(i.to_bytes(4, "little") for i in memory.tokenizer.encode(text, add_special_tokens=False).ids)
        if not ("\0" in text or ".." in text or ",," in text or ".," in text or ",." in text):
            chunks = text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").split("\0")
            ids = list(map(memory.__getitem__, chunks))
            if None in ids:
                out, i = [], 0
                ids.append(None)
                while (bad := ids.index(None, i)) < len(chunks):
                    out += ids[i:bad]
                    i = bad + 1  # with what follows, up to the next letter or digit that ends a chunk
                    while i < len(chunks) and not chunks[i - 1][-1:].isalnum():
                        i += 1
                    out += map(memory.remembered, memory.find("".join(chunks[bad:i])))
                return b"".join(out + ids[i:-1])
            return b"".join(ids)
        return b"".join(map(memory.remembered, memory.find(text)))

    return encode


def split_at(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than the capacity."""
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, n, capacity)]


def tokenize_pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: its ids followed by ``end_id``, cut only where longer than
    ``capacity``. A null text counts as empty and so gives one piece of one id; null or repeated
    ``doc_id`` are carried as they are."""
    ship(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, pattern)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []] + [[]] * with_ids
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(split_at(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    row = [doc, k, start, length, zlib.crc32(part)]
                    if with_ids:
                        row.append([int.from_bytes(part[i : i + 4], "little") for i in range(0, len(part), 4)])
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return pick(docs, "doc_id", "text").mapInArrow(in_worker("packing", run), PIECES_IDS if with_ids else PIECES)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id``, ``piece``, ``start`` and ``length``
    (1..capacity). ``pieces`` is read several times and should be a written table. Equal pieces in any
    number, from any document, are placed each on its own; no rows give no rows."""
    spark: SparkSession = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = best_fit_plan(histogram, capacity)
    rows = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "length long, rank_from long, rank_to long, first long, at int")
    if len(plan) <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    salts = max(16, sum(histogram.values()) // RANKED_ROWS)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_own"))
    placed = ranked.join(rows, (ranked["length"] == rows["length"]) & (ranked["_rank"] >= rows["rank_from"]) & (ranked["_rank"] < rows["rank_to"]))
    return placed.select(*[ranked[c] for c in pieces.columns], (F.col("first") + F.col("_rank") - F.col("rank_from")).alias("sequence_id"), F.col("at").cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack documents into as few sequences of at most ``capacity`` ids as best-fit decreasing gives.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, on request,
    the ``ids`` themselves. Null text: empty. Repeated rows are packed once each. An empty table gives an
    empty result. A long text is cut into pieces, never shortened. Other columns are not looked at."""
    if tokenizer is None or pattern is None:
        import public_tokenizers as public

        tokenizer, pattern = tokenizer or public.path("byte_bpe_50k.json"), pattern or public.PATTERN
    pieces = cut(tokenize_pieces(docs, tokenizer, pattern, capacity, end_id, with_ids), "pieces")
    return place(pieces, capacity)
