"""Repeated windows of fixed length, found by passes over ever longer leading content.

The windows of ``length`` items are dealt by digits that are functions of the window
alone, and a window leaves as soon as nobody shares its digits:

1. the *anchor*, the window's least hashed ``gram`` (leftmost on ties). Neighbouring
   windows share it, so one row stands for a run of windows, about 2 rows per
   ``length - gram`` items. With ``doubling`` a run goes on only if its gram occurs again,
   and then with the double of it: the gram and as many items behind it, where its windows
   hold these, else in front of it;
2. the *segment*, all items that the run's windows cover. Runs with equal segments are
   equal window by window, so only one of them goes on;
3. only where one anchor has several segments (at the edges of repeated passages): the
   windows themselves, a row each.

Segments and windows are told apart by 128 bits: for segments 64 bits of BLAKE2b beside the
64 bits of the anchor's hash, for windows BLAKE2b alone. Each pass deals rows by its
digits and sorts them (Spark's external sort, which spills), then streams over them with
one row of memory, so no group is ever held. Before that a task looks at ``HELD`` rows at
once: of rows that are equal there only the first is dealt by its digit, the others
are settled and pass evenly. So a digit with a third of all rows has one row in so many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import cut, small_batches

U = np.uint64
#: Windows handled at once; longer documents go in pieces, so memory stays bounded.
PIECE = 1 << 19
#: Rows that a task compares before they are dealt.
HELD = 1 << 18
_POS = U((1 << 20) - 1)
#: Rows' kinds: alone among those held, already known as repeated, first of several held.
ALONE, KNOWN, FIRST = 0, 1, 2
_RUNS = pa.schema([("a", pa.int64()), ("seg", pa.int64()), ("doc", pa.int64()), ("pl", pa.int64())])
_LEVEL = pa.schema([("g", pa.int64()), *_RUNS])
_FOUND = pa.schema([("doc", pa.int64()), ("pl", pa.int64()), ("open", pa.int8())])
_WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc", pa.int64()), ("pl", pa.int64())])

#: A text's UTF-8 -> a value for each item, the items' bytes in a row, bytes an item.
Items = Callable[[bytes], tuple[np.ndarray, memoryview, int]]


def byte_items(data) -> tuple[np.ndarray, memoryview, int]:
    """The items are bytes."""
    return T.BYTES[np.frombuffer(data, np.uint8)], memoryview(data), 1


def word_items(data) -> tuple[np.ndarray, memoryview, int]:
    """The items are words, unchanged, by their digests."""
    d = T.word_digests(T.words(bytes(data)))
    return np.ascontiguousarray(d[:, 0]), memoryview(np.ascontiguousarray(d).tobytes()), 16


def polynomial(x: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` neighbours, at the same cost for every length."""
    h = T.prefix(x)
    return T.mix((h[gram:] - h[:-gram]) * T.powers(T.BASE, len(h))[1][: len(h) - gram])


def doubled(x: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` neighbours, out of those of half as many."""
    if gram == 1:
        return T.mix(x)
    half = gram // 2
    y = doubled(x, half)
    out = T.join(y[: len(y) - half], y[half:])
    return out if gram == 2 * half else T.join(out[:-1], x[gram - 1 :])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours, by doubling."""
    span = 1
    while 2 * span <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (w - span)], v[w - span :]) if w > span else v


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor's place of each run of windows of ``width`` grams with one anchor."""
    keys = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(keys, width) & _POS).astype(np.int64)
    turn = np.flatnonzero(at[1:] != at[:-1]) + 1
    lo = np.concatenate(([0], turn))
    return lo, np.concatenate((turn - 1, [len(at) - 1])), at[lo]


def _segments(buffer: memoryview, size: int, lo: np.ndarray, hi: np.ndarray, p: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit value of the items that windows lo to hi cover, and of the anchor's place there."""
    shape = ((p - lo) << 10 | (hi - lo)).astype(np.uint64)
    return T.mix(T.span_digests(buffer, lo * size, (hi + length) * size)[:, 0] + shape * T.GOLDEN).view(np.int64)


def _pack(lo, e, kind=0):
    return (lo << 12) | (e << 2) | kind


def unpack(pl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and windows less 1."""
    return pl >> 12, (pl >> 2) & 1023


def _kinds(keys: list[np.ndarray], doc: np.ndarray, pl: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows ordered by keys, doc and pl, their kinds in ``pl``. Known rows get keys of their own."""
    order = np.lexsort((pl, doc, *keys[::-1]))
    keys, doc, pl = [k[order] for k in keys], doc[order], pl[order] & ~3
    again = np.zeros(len(doc), bool)
    again[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    first = np.zeros(len(doc), bool)
    first[:-1] = again[1:] & ~again[:-1]
    pl = pl | np.where(again, KNOWN, np.where(first, FIRST, ALONE))
    spread = T.mix((pl ^ doc).view(np.uint64)).view(np.int64)
    return [np.where(again, spread, keys[0]), *[np.where(again, 0, k) for k in keys[1:]]], doc, pl


def _held(rows: Iterator[list[np.ndarray]], finish: Callable) -> Iterator[pa.RecordBatch]:
    """``finish`` over stretches of at least ``HELD`` rows, and over the rest."""
    parts, n = [], 0
    for r in rows:
        parts.append(r)
        n += len(r[0])
        if n >= HELD:
            yield finish([np.concatenate(x) for x in zip(*parts)])
            parts, n = [], 0
    if n:
        yield finish([np.concatenate(x) for x in zip(*parts)])


def _batch(cols: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch], length: int):
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            if text.is_valid and len(data := text.as_buffer()) >= length:
                yield doc, data


def _find_runs(items: Items, length: int, gram: int):
    """a (the anchor), seg, doc, pl of all runs."""

    def rows(batches):
        for doc, data in _texts(batches, length):
            x, buffer, size = items(data)
            for c in range(0, len(x) - length + 1, PIECE):
                grams = polynomial(x[c : c + PIECE + length - 1], gram)
                lo, hi, p = anchors(grams, length - gram + 1)
                seg = _segments(buffer[c * size :], size, lo, hi, p, length)
                yield [grams[p].view(np.int64), seg, np.full(len(lo), doc, np.int64), _pack(lo + c, hi - lo)]

    def finish(cols):
        (a, seg), doc, pl = _kinds(cols[:2], *cols[2:])
        return _batch([a, seg, doc, pl], _RUNS)

    return lambda batches: _held(rows(batches), finish)


def _find_parts(items: Items, length: int, gram: int):
    """g (the gram), a (its double), seg, doc, pl of all runs, cut in two where not all windows hold the double behind the gram."""
    if length < 3 * gram - 1:
        raise ValueError("a window must hold the double of its gram on one side, wherever that stands: 3 * gram - 1 items")

    def rows(batches):
        for doc, data in _texts(batches, length):
            x, buffer, size = items(data)
            for c in range(0, len(x) - length + 1, PIECE):
                grams = doubled(x[c : c + PIECE + length - 1], gram)
                doubles = T.join(grams[:-gram], grams[gram:])  # 2 * gram items from each place
                lo, hi, p = anchors(grams, length - gram + 1)
                turn = p - (length - 2 * gram)  # from this window on the double behind the gram is inside
                after, before = hi >= turn, lo < turn
                los = np.concatenate((np.maximum(lo, turn)[after], lo[before]))
                his = np.concatenate((hi[after], np.minimum(hi, turn - 1)[before]))
                ps = np.concatenate((p[after], p[before]))
                a = np.concatenate((doubles[p[after]], T.mix(doubles[p[before] - gram] + U(1))))
                seg = _segments(buffer[c * size :], size, los, his, ps, length)
                g = np.concatenate((grams[p[after]], T.mix(grams[p[before]] + U(1))))  # the two halves of a run aren't each other's copies
                yield [g.view(np.int64), a.view(np.int64), seg, np.full(len(los), doc, np.int64), _pack(los + c, his - los)]

    def finish(cols):
        g, a, seg, doc, pl = cols
        order = np.argsort(g, kind="stable")
        g, a, seg, doc, pl = (x[order] for x in cols)
        again = np.zeros(len(g), bool)
        again[1:] = g[1:] == g[:-1]
        first = np.zeros(len(g), bool)
        first[:-1] = again[1:] & ~again[:-1]
        pl = pl | np.where(again, KNOWN, np.where(first, FIRST, ALONE))
        return _batch([np.where(again, T.mix((pl ^ doc).view(np.uint64)).view(np.int64), g), a, seg, doc, pl], _LEVEL)

    return lambda batches: _held(rows(batches), finish)


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by g: those whose g isn't alone, as rows of ``_find_runs``."""

    def rows():
        last = None  # the row before, if it stood alone so far
        g0 = None
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            g, kind = cols[0], cols[4] & 3
            known = kind == KNOWN
            yield [c[known] for c in cols[1:]]
            g, *rest = (c[~known] for c in cols)
            kind = kind[~known]
            if not len(g):
                continue
            same = np.zeros(len(g), bool)
            same[1:] = g[1:] == g[:-1]
            same[0] = g0 is not None and g[0] == g0
            lives = same | (kind == FIRST)
            lives[:-1] |= same[1:]
            if same[0] and last is not None:
                yield last
            yield [c[lives] for c in rest]
            g0 = g[-1]
            last = None if lives[-1] else [c[-1:] for c in rest]

    def finish(cols):
        (a, seg), doc, pl = _kinds(cols[:2], *cols[2:])
        return _batch([a, seg, doc, pl], _RUNS)

    return _held(rows(), finish)


def _settle_runs(both: bool):
    """Over rows sorted by a, seg, doc, pl. Later rows of a segment are repeated (``both``: the first too);
    firsts of segments whose anchor has another segment stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # a, seg of the last row; doc, pl of its segment's first row if that is still unmarked; its anchor's first row; segments of the anchor so far (at most 2)
        for b in batches:
            a, seg, doc, pl = (c.to_numpy() for c in b.columns)
            known = (pl & 3) == KNOWN
            docs, pls, opens = [doc[known]], [pl[known]], [np.zeros(known.sum(), np.int8)]
            a, seg, doc, pl = a[~known], seg[~known], doc[~known], pl[~known]
            n = len(a)
            if n:
                if carry is None:
                    carry = {"a": ~a[0], "seg": 0, "first": None, "start": None, "segs": 0}
                same_a, same = np.empty(n, bool), np.empty(n, bool)
                same_a[1:] = a[1:] == a[:-1]
                same[1:] = same_a[1:] & (seg[1:] == seg[:-1])
                same_a[0] = a[0] == carry["a"]
                same[0] = same_a[0] and seg[0] == carry["seg"]
                mark = same.copy()
                if both:
                    mark |= (pl & 3) == FIRST
                    mark[:-1] |= same[1:]
                    if same[0] and carry["first"] is not None:
                        docs.append(np.array([carry["first"][0]])), pls.append(np.array([carry["first"][1]])), opens.append(np.zeros(1, np.int8))
                docs.append(doc[mark]), pls.append(pl[mark]), opens.append(np.zeros(mark.sum(), np.int8))
                # segments of the anchor before and with each row
                index = np.arange(n)
                begin = np.maximum.accumulate(np.where(same_a, -1, index))  # -1: the anchor began in an earlier batch
                new = (~same).astype(np.int64)
                upto = np.cumsum(new)
                ordinal = upto - np.where(begin >= 0, upto[begin] - 1, -carry["segs"])
                opened = ~same & (ordinal >= 2)
                docs.append(doc[opened]), pls.append(pl[opened]), opens.append(np.ones(opened.sum(), np.int8))
                second = np.flatnonzero(~same & (ordinal == 2))
                inside = begin[second]
                held = inside[inside >= 0]
                docs.append(doc[held]), pls.append(pl[held]), opens.append(np.ones(len(held), np.int8))
                if (inside < 0).any():
                    docs.append(np.array([carry["start"][0]])), pls.append(np.array([carry["start"][1]])), opens.append(np.ones(1, np.int8))
                start = carry["start"] if begin[-1] < 0 else (doc[begin[-1]], pl[begin[-1]])
                last_first = None if same[-1] or mark[-1] else (doc[-1], pl[-1])
                carry = {"a": a[-1], "seg": seg[-1], "first": last_first, "start": start, "segs": min(2, int(ordinal[-1]))}
            yield _batch([np.concatenate(docs), np.concatenate(pls), np.concatenate(opens)], _FOUND)

    return run


def _open_windows(items: Items, length: int):
    """w1, w2 (a window's digest), doc, pl of each window in the given runs."""

    def rows(batches):
        for b in batches:
            for doc, text, pls in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                _, buffer, size = items(text.as_buffer())
                lo, e = unpack(np.unique(pls.values.to_numpy()))
                for g in range(0, len(lo), 2048):
                    first, count = lo[g : g + 2048], e[g : g + 2048] + 1
                    at = np.unique(np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()))
                    w = T.span_digests(buffer, at * size, (at + length) * size).view(np.int64)
                    yield [w[:, 0], w[:, 1], np.full(len(at), doc, np.int64), _pack(at, 0)]

    def finish(cols):
        keys, doc, pl = _kinds(cols[:2], *cols[2:])
        return _batch([*keys, doc, pl], _WINDOWS)

    return lambda batches: _held(rows(batches), finish)


def _settle_windows(both: bool):
    """Over rows sorted by w1, w2, doc, pl: later rows of a window are repeated (``both``: the first too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # w1, w2, doc, pl, marked
        for b in batches:
            w1, w2, doc, pl = (c.to_numpy() for c in b.columns)
            known = (pl & 3) == KNOWN
            docs, pls = [doc[known]], [pl[known]]
            w1, w2, doc, pl = w1[~known], w2[~known], doc[~known], pl[~known]
            if len(w1):
                same = np.empty(len(w1), bool)
                same[1:] = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
                same[0] = last is not None and w1[0] == last[0] and w2[0] == last[1]
                mark = same.copy()
                if both:
                    mark |= (pl & 3) == FIRST
                    mark[:-1] |= same[1:]
                    if same[0] and not last[4]:
                        docs.append(np.array([last[2]])), pls.append(np.array([last[3]]))
                docs.append(doc[mark]), pls.append(pl[mark])
                last = (w1[-1], w2[-1], doc[-1], pl[-1], bool(mark[-1]))
            docs, pls = np.concatenate(docs), np.concatenate(pls)
            yield _batch([docs, pls, np.zeros(len(docs), np.int8)], _FOUND)

    return run


def repeated(texts: DataFrame, items: Items, length: int, gram: int, both: bool, doubling: bool = False) -> DataFrame:
    """``doc`` and ``pls``, packed runs of repeated windows: every window whose content also
    starts earlier (smaller doc, then smaller place), or with ``both`` anywhere else.

    Documents without repeated windows have no row. ``texts`` has ``doc``, each once, and ``text``.
    """
    spark = texts.sparkSession
    small_batches(spark)
    if length - gram + 1 > 1023:
        raise ValueError("length - gram must be below 1023")
    read = texts.select("doc", F.col("text").cast("binary").alias("data"))
    runs_schema = "a long, seg long, doc long, pl long"
    if doubling:
        level = read.mapInArrow(_find_parts(items, length, gram), f"g long, {runs_schema}")
        found = level.repartition("g").sortWithinPartitions("g").mapInArrow(_survivors, runs_schema)
    else:
        found = read.mapInArrow(_find_runs(items, length, gram), runs_schema)
    found = found.repartition("a").sortWithinPartitions("a", "seg", "doc", "pl")
    runs_ = cut(found.mapInArrow(_settle_runs(both), "doc long, pl long, open byte"))
    open_ = runs_.where("open = 1").groupBy("doc").agg(F.collect_list("pl").alias("pls"))
    windows = read.join(open_, "doc").select("doc", "data", "pls").mapInArrow(_open_windows(items, length), "w1 long, w2 long, doc long, pl long")
    windows = windows.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "w1").sortWithinPartitions("w1", "w2", "doc", "pl")
    single = windows.mapInArrow(_settle_windows(both), "doc long, pl long, open byte")
    marks = runs_.where("open = 0").unionByName(single)
    return marks.groupBy("doc").agg(F.collect_list("pl").alias("pls"))


def covered(pls: np.ndarray | None, length: int, n: int) -> np.ndarray:
    """Which of ``n`` items lie in one of the windows."""
    if pls is None or not len(pls) or n < length:
        return np.zeros(n, bool)
    lo, e = unpack(pls)
    depth = np.bincount(np.minimum(lo, n), minlength=n + 1) - np.bincount(np.minimum(lo + e + length, n), minlength=n + 1)
    return np.cumsum(depth[:-1]) > 0
