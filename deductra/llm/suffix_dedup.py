"""Suffix-array dedup by a depth-limited radix sort.

Every place of a document starts a suffix; suffixes are ordered only through ``length``
bytes, by passes over content digits, most significant first (see ``_windows``). Groups
that stay equal to that depth are exactly the repeated windows; each but its first member
is removed, that is every byte that it covers.

Defined results. Null text: empty. Texts shorter than ``length`` bytes: unchanged. Equal
texts: the smallest doc_id keeps its bytes. Null doc_id sorts first. Texts that share a
doc_id, nulls included, are documents of their own, in the order of a hash of the text; rows
that repeat doc_id and text count as one document and get the same result. Very long texts
go in pieces of ``PIECE`` windows, without an edge in the result. An empty table gives an
empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _windows as W
from ._spark import Documents, cut, fresh, scratch, small_batches

LENGTH, GRAM = 100, 40


_RESULT = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, pls in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)
                gone = W.covered(pls.values.to_numpy() if pls.is_valid else None, length, len(data))
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 5, _RESULT)], schema=_RESULT)

    return run


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is kept, for every document."""
    small_batches(docs.sparkSession)
    own = Documents(docs)
    texts = own.texts()
    with scratch():
        marks = W.repeated(texts, W.byte_items, length, gram, both=False)
        joined = texts.select("doc", F.col("text").cast("binary").alias("data")).join(marks, "doc", "left").select("doc", "data", "pls")
        out = cut(joined.mapInArrow(_strip(length), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), keep=True)
    return own.named(own.expanded(out), doc_id="doc").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def kept_text(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with each repeated window's later copies cut out of ``text``, and ``n_chars`` to match.

    A character that loses some of its bytes goes whole. All rows stay, null texts as they are.
    """
    small_batches(docs.sparkSession)
    own = Documents(docs)
    with scratch():
        marks = cut(W.repeated(own.texts(), W.byte_items, length, gram, both=False), keep=True)
    key, cuts = fresh(docs, "_doc"), fresh(docs, "_pls")
    rest = own.tagged(key).join(marks.select(F.col("doc").alias(key), F.col("pls").alias(cuts)), key, "left").drop(key)
    schema = docs.schema
    place = schema.fieldNames().index("text")
    chars = schema.fieldNames().index("n_chars") if "n_chars" in schema.fieldNames() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lengths = [], []
            for text, pls in zip(b.column(place), b.column(b.num_columns - 1)):
                if not text.is_valid or not pls.is_valid:
                    texts.append(text.as_py())
                else:
                    data = np.frombuffer(text.as_buffer(), np.uint8)
                    texts.append(data[~W.covered(pls.values.to_numpy(), length, len(data))].tobytes().decode("utf-8", "ignore"))
                lengths.append(None if texts[-1] is None else len(texts[-1]))
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols[place] = pa.array(texts, pa.string())
            if chars is not None:
                cols[chars] = pa.array(lengths, cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return rest.select(*docs.columns, cuts).mapInArrow(run, schema)
