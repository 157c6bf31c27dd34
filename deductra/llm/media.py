"""Media columns: content-addressed payloads in tar shards.

A payload (a text's UTF-8, padded by bytes 255 to a positive multiple of ``UNIT``) is
stored losslessly as an 8-bit greyscale PNG, ``WIDTH`` samples a row. Each task packs the
images it makes into one tar file in the shared folder, each content once; the file's name
is a digest of its members, so a task that runs again writes the same file. Rows carry
the content's digest and shard, offset and length. Equal contents that several
tasks stored resolve to the least (shard, offset), by an aggregate over narrow rows.

Reading back goes by byte ranges: the header's 33 bytes alone fill the metadata columns, and
only then a reader of the samples fetches the rest. Texts never travel through a shuffle.

Defined results. Null or empty text: one unit of bytes 255. Equal texts: equal digests,
payloads and places. Null ids and repeated rows: a row each. Empty table: no rows. Other
columns are not read. Very long texts: the image grows in height; a task holds one image.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import cut, doc_id, keyed, shared_dir, small_batches

UNIT, WIDTH = 576, 576
HEADER = 33
_SIGN = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None, unit: int = UNIT) -> bytes:
    """UTF-8 and padding."""
    data = T.utf8(text)
    return data + b"\xff" * (-len(data) % unit if data else unit)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(data: bytes, width: int = WIDTH) -> bytes:
    """A greyscale PNG of the bytes, ``width`` a row, unfiltered."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits from the first ``HEADER`` bytes."""
    if data[:8] != _SIGN or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, bits = struct.unpack(">IIB", data[16:25])
    return width, height, bits


def decode(data: bytes) -> bytes:
    """The samples of what ``encode`` made."""
    width, height, _ = header(data)
    at, packed = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """16 mean intensities over equal stretches of the samples and the 16-bin histogram's shares, as hex digits."""
    x = np.frombuffer(samples, np.uint8)
    means = np.add.reduceat(x, np.arange(16) * len(x) // 16, dtype=np.int64) // np.diff(np.append(np.arange(16) * len(x) // 16, len(x)))
    shares = np.bincount(x >> 4, minlength=16) * 255 // len(x)
    return bytes([*means.astype(np.uint8), *shares.astype(np.uint8)]).hex()


def _store(where: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(where)


def store(docs: DataFrame, where: str | None = None) -> DataFrame:
    """Write all payloads into tar shards under ``where``; doc, n_bytes, digest, shard, offset, length, and home, the shard of the task that read the row."""
    spark = docs.sparkSession
    where = where or f"{shared_dir(spark)}/deductra/media-{uuid.uuid4().hex}"
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _store(where)
        files.create_dir(root, recursive=True)
        part = f"{root}/.part-{uuid.uuid4().hex}"
        members = hashlib.sha256()
        places: dict[bytes, tuple[int, int]] = {}
        rows: list[tuple] = []
        with files.open_output_stream(part) as out:
            at = 0
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                    raw = text.as_py()
                    data = payload(raw)
                    digest = hashlib.sha256(data).digest()
                    if digest not in places:
                        image = encode(data)
                        entry = tarfile.TarInfo(digest.hex() + ".png")
                        entry.size = len(image)
                        head = entry.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + image + b"\0" * (-len(image) % 512))
                        places[digest] = at + len(head), len(image)
                        at += len(head) + len(image) + -len(image) % 512
                        members.update(digest)
                    rows.append((doc, len(T.utf8(raw)), digest))
            out.write(b"\0" * 1024)
        name = f"{members.hexdigest()[:32]}.tar"
        files.move(part, f"{root}/{name}")
        for g in range(0, len(rows), 10_000):
            some = rows[g : g + 10_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2].hex() for r in some], pa.string()), pa.array([name] * len(some), pa.string()),
                    pa.array([places[r[2]][0] for r in some], pa.int64()), pa.array([places[r[2]][1] for r in some], pa.int64()),
                ],
                names=["doc", "n_bytes", "digest", "shard", "offset", "length"],
            )

    rows = cut(keyed(docs).mapInArrow(run, "doc long, n_bytes long, digest string, shard string, offset long, length long"))
    # where each content's copies are read from; joined by content and shard, so that a content with a third of all rows is dealt by its many shards
    short = rows.withColumn("digest", F.unhex("digest"))
    first = short.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    places = short.select("digest", F.col("shard").alias("home")).distinct().join(first, "digest")
    out = short.select("doc", "n_bytes", "digest", F.col("shard").alias("home")).join(places, ["digest", "home"]).select("doc", "n_bytes", F.lower(F.hex("digest")).alias("digest"), "place.*", "home")
    out = cut(out, keep=True)
    out._deductra_media = where
    return out


def _ranges(where: str, rows, length=None) -> Iterator[bytes]:
    """The stored bytes of (shard, offset, length) rows, one open file at a time."""
    files, root = _store(where)
    name, source = None, None
    try:
        for shard, offset, size in rows:
            if shard != name:
                if source is not None:
                    source.close()
                name, source = shard, files.open_input_file(f"{root}/{shard}")
            yield source.read_at(min(size, length or size), offset)
    finally:
        if source is not None:
            source.close()


def _places(b: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length"))))


def metadata(stored: DataFrame, where: str) -> DataFrame:
    """Width, height and bits of each row by header-only range reads; rows that follow one with the same place share its read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, None
        for b in batches:
            places = _places(b)
            new = [p != q for p, q in zip(places, [last, *places])]
            heads = _ranges(where, itertools.compress(places, new), HEADER)
            rows = []
            for fresh_ in new:
                if fresh_:
                    found = header(next(heads))
                rows.append(found)
            last = places[-1] if places else last
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int32()) for c in cols)], names=[*b.schema.names, "width", "height", "bits"])

    return stored.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema) + ", width int, height int, bits int")


def features(docs: DataFrame, where: str | None = None) -> DataFrame:
    """Store every document, read the stored bytes back and describe them."""
    where = where or f"{shared_dir(docs.sparkSession)}/deductra/media-{uuid.uuid4().hex}"
    stored = store(docs, where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, None
        for b in batches:
            out = []
            docs_, sizes, shapes = b.column("doc").to_pylist(), b.column("n_bytes").to_pylist(), list(zip(b.column("width").to_pylist(), b.column("height").to_pylist()))
            places = _places(b)
            new = [i for i, p in enumerate(places) if p != (places[i - 1] if i else last)]
            images = _ranges(where, [places[i] for i in new])
            starts = set(new)
            for i, p in enumerate(places):
                if i in starts:
                    image = next(images)
                    samples = decode(image)
                    found = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples))
                out.append((docs_[i], sizes[i], *found, *shapes[i]))
                last = p
            cols = list(zip(*out)) or [[]] * 10
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"])

    # sorted by place: a task reads each content once; rows of a hot content stay as spread as they were read
    placed = stored.repartition("shard", F.floor(F.col("offset") / F.lit(1 << 20)), "home").sortWithinPartitions("shard", "offset")
    out = metadata(placed, where).mapInArrow(run, "doc long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int")
    return out.select(doc_id(), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
