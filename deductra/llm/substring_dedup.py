"""Substring dedup over words by level-wise doubling: 9, 18, 35 words.

Level 1 looks at windows of ``gram`` words, at places that the content itself picks, so that
every window of ``length`` words has one at a fixed place of its own. Those that occur
nowhere else end there. Level 2 looks at twice as many words, those behind the gram or, where
the window ends before, those in front of it; again what is alone ends. What is left is
extended to ``length`` words: first the whole stretch that the windows of one gram cover,
and, where stretches differ, window by window (see ``_windows``). No candidate is left then.

Words are told apart by BLAKE2b digests of 128 bits, windows by digests of these.

Defined results. Words are maximal runs of bytes other than space and \\x09-\\x0D, unchanged.
Null or empty text: no words, nothing removed. Fewer than ``length`` words: unchanged.
Equal texts of at least ``length`` words lose all words, since each window starts elsewhere
too. Texts that share a doc_id, nulls included, are documents of their own; rows that repeat
doc_id and text count as one document. Very long texts go in pieces of ``PIECE`` windows,
without an edge in the result. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from . import _windows as W
from ._spark import Documents, cut, scratch, small_batches

LENGTH, GRAM = 35, 9
_RESULT = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, pls in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                words = T.words(bytes(text.as_buffer())) if text.is_valid else []
                gone = W.covered(pls.values.to_numpy() if pls.is_valid else None, length, len(words))
                kept = b" ".join(itertools.compress(words, (~gone).tolist()) if gone.any() else words)
                out.append((doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 4, _RESULT)], schema=_RESULT)

    return run


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words, for every document."""
    small_batches(docs.sparkSession)
    own = Documents(docs)
    texts = own.texts()
    with scratch():
        marks = W.repeated(texts, W.word_items, length, gram, both=True, doubling=True)
        joined = texts.select("doc", F.col("text").cast("binary").alias("data")).join(marks, "doc", "left").select("doc", "data", "pls")
        out = cut(joined.mapInArrow(_strip(length), "doc long, n_words long, n_removed long, kept_sha256 string"), keep=True)
    return own.named(own.expanded(out), doc_id="doc").select("doc_id", "n_words", "n_removed", "kept_sha256")
