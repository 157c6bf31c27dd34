"""Packing of tokenised documents into sequences by minimum bin slack.

Documents are cut at multiples of the sequence length, so only remainders are shorter. All
that the packing needs to know is how many pieces have each length: at most ``capacity``
numbers, whatever the corpus holds. On these a bitset subset-sum program fills one window
at a time: it takes the longest piece, then the multiset of the other lengths whose sum
comes closest to the capacity, backtracked into counts, and repeats that filling as often
as the counts allow. Pieces find their places by their number among those of equal length,
a range join with the plan, which grows with the capacity and hardly with the corpus.

Defined results. Null or empty text: the end id alone. Ties and repeated rows: pieces of
equal length are interchangeable; each row is packed. Null doc_id: packed, given back null.
Very long texts: cut into pieces like all others; a task
holds one text's ids. An empty table: no pieces. Other columns are not read.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, doc_id, keyed, slots, small_batches
from .bpe import default_path, vocabulary

CAPACITY, END_ID = 4096, 2
#: Bytes of a plan that is broadcast; a larger one is joined by a shuffle.
BROADCAST = 16 << 20
#: Words that a worker remembers at most.
CACHED = 1_000_000


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit values, by the tokenizers library; new words in batches."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.v = vocabulary(path)
        names = self.v.names
        self.ends = np.array([names.get(i, "").endswith("</w>") or names.get(i) in self.v.special for i in range(max(names) + 1)])

    def learn(self, words: set) -> None:
        if len(self) > CACHED:
            self.clear()
        new = [w for w in words if w not in self]
        for g in range(0, len(new), 1000):  # the library slows down on long texts
            some = new[g : g + 1000]
            ids = np.array(self.library.encode(" ".join([w if isinstance(w, str) else w.decode("latin-1") for w in some]), add_special_tokens=False).ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(some):  # a word that doesn't stand alone in the joined text
                for w in some:
                    self[w] = np.array(self.v.encode_word(w), "<u4").tobytes()
                continue
            raw, begin = ids.tobytes(), 0
            for w, end in zip(some, (4 * last).tolist()):
                self[w] = raw[begin:end]
                begin = end


@functools.lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc, start, length, ids_crc32, doc_tokens: each document's ids with the end id, cut at multiples of ``capacity``."""
    path = path or default_path()
    small_batches(docs.sparkSession)
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_ids(path)
        for b in batches:
            rows = []
            for g in range(0, b.num_rows, 64):
                words = [known.v.keys(t or "") for t in b.column(1).slice(g, 64).to_pylist()]
                known.learn(set().union(*words))
                for doc, w in zip(b.column(0).slice(g, 64).to_pylist(), words):
                    data = b"".join([*map(known.__getitem__, w), last])
                    total = len(data) // 4
                    for start in range(0, total, capacity):
                        part = data[4 * start : 4 * (start + capacity)]
                        rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "start", "length", "ids_crc32", "doc_tokens"])

    return keyed(docs).mapInArrow(run, "doc long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Minimum bin slack over a multiset of lengths: (times, lengths with their counts) of each filling."""
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left, reverse=True)
    out = []
    while left:
        while order[0] not in left:
            order.pop(0)
        longest = order[0]
        room = capacity - longest
        use = {longest: 1}
        reach, steps, mask = 1, [], (1 << (room + 1)) - 1
        for n in order:
            if n > room or n not in left:
                continue
            many, k = min(left[n] - (n == longest), room // n), 1
            while many > 0:
                k = min(k, many)
                more = reach | (reach << (n * k)) & mask
                if more != reach:
                    steps.append((n, k, reach))
                    reach = more
                many -= k
                k *= 2
            if reach >> room & 1:
                break
        at = reach.bit_length() - 1
        for n, k, before in reversed(steps):
            if not before >> at & 1:
                at -= n * k
                use[n] = use.get(n, 0) + k
        times = min(left[n] // k for n, k in use.items())
        for n, k in use.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        out.append((times, use))
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """length, first and end number among the pieces of that length, first sequence, pieces a sequence, offset of the first."""
    rows, used, sequence = [], {}, 0
    for times, use in fill(counts, capacity):
        offset = 0
        for n, k in use.items():
            first = used.get(n, 0)
            used[n] = first + times * k
            rows.append((n, first, used[n], sequence, k, offset))
            offset += n * k
        sequence += times
    return rows


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece with its sequence and its offset there."""
    spark = docs.sparkSession
    cut_pieces = cut(pieces(docs, path, capacity, end_id))
    counts = {r[0]: r[1] for r in cut_pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    layout = np.array(plan(counts, capacity) or np.zeros((0, 6)), np.int64).reshape(-1, 6)
    table = pa.table({c: layout[:, i] for i, c in enumerate(["length", "first", "stop", "base", "each", "at"])})
    placed = spark.createDataFrame(table)
    numbered = slots(cut_pieces, "length", ["doc", "start", "ids_crc32", "doc_tokens"], out="number")
    placed = F.broadcast(placed) if layout.nbytes <= BROADCAST else placed
    joined = numbered.join(placed, "length").where("number >= first and number < stop")
    return joined.select(
        doc_id(), "start", "length", "ids_crc32", "doc_tokens",
        F.expr("base + (number - first) div each").alias("sequence_id"),
        F.expr("at + (number - first) % each * length").alias("offset"),
    )
