"""Operator 7: payloads stored as PNG columns, read back with checks, and cosine-transform features.

A text's bytes are filled up with bytes 255 to a positive multiple of ``ROW`` and stored
as an 8-bit grey image of that width in a binary column. Writing chooses a row filter by
the smallest sum of differences; reading goes through the chunks, tests their lengths
and CRC-32 sums, inflates the data and undoes all five row filters with numpy. Files
that fail a test, and kinds of image other than 8-bit grey without interlace, raise.

The feature shrinks the image to 32 x 32 by area means, takes the low frequencies of its
cosine transform and sets a bit for each that lies above their median: 8 bytes in a
binary column.

Nulls count as empty texts; equal texts give equal bytes. Images are at most as large as
their text, and rows stay where they are. Outputs replace kept columns of the same name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.llm.tables import map_rows, slices

ROW = 576
LEVEL = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8
#: The first rows of the cosine transform.
_COSINES = np.cos(np.pi / SIDE * (np.arange(SIDE)[None, :] + 0.5) * np.arange(LOW)[:, None])


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: bytes, width: int = ROW) -> bytes:
    """A grey 8-bit image of rows of ``width`` samples."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, width)
    above = np.vstack([np.zeros((1, width), np.uint8), image[:-1]])
    before = np.hstack([np.zeros((len(image), 1), np.uint8), image[:, :-1]])
    filtered = np.stack([image, image - before, image - above])  # none, sub, up
    cost = np.abs(filtered.view(np.int8).astype(np.int16)).sum(2)
    kind = cost.argmin(0)
    rows = np.hstack([kind[:, None].astype(np.uint8), filtered[kind, np.arange(len(image))]])
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of the chunks up to the end chunk, each after its tests."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while True:
        if at + 12 > len(png):
            raise ValueError("the file ends inside a chunk or before the end chunk")
        size = int.from_bytes(png[at:at + 4], "big")
        kind, data, crc = png[at + 4:at + 8], png[at + 8:at + 8 + size], png[at + 8 + size:at + 12 + size]
        if len(crc) < 4 or int.from_bytes(crc, "big") != zlib.crc32(kind + data):
            raise ValueError(f"the checksum of chunk {kind!r} is wrong")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size


def _paeth(left: int, up: int, corner: int) -> int:
    guess = left + up - corner
    near = min(abs(guess - left), abs(guess - up), abs(guess - corner))
    return left if near == abs(guess - left) else up if near == abs(guess - up) else corner


def unfilter(rows: np.ndarray) -> np.ndarray:
    """The image of rows that begin with their filter's number; one byte a sample."""
    image = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    above = np.zeros(rows.shape[1] - 1, np.uint8)
    for k, (kind, row) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:])):
        if kind == 0:
            own = row
        elif kind == 1:
            own = np.cumsum(row, dtype=np.uint8)
        elif kind == 2:
            own = row + above
        elif kind in (3, 4):
            values, left, corner = [], 0, 0
            for x, up in zip(row.tolist(), above.tolist()):
                left = (x + ((left + up) // 2 if kind == 3 else _paeth(left, up, corner))) & 255
                corner = up
                values.append(left)
            own = np.array(values, np.uint8)
        else:
            raise ValueError(f"unknown row filter {kind}")
        image[k] = above = own
    return image


def read_png(png: bytes) -> np.ndarray:
    """The samples of a grey 8-bit image, a row of the array for each of its rows."""
    head, data = None, []
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlace are read")
    raw = zlib.decompress(b"".join(data))
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("the image data has another size than the header says")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1))


def _shrunk(image: np.ndarray, axis: int) -> np.ndarray:
    """Means over SIDE even stretches of an axis; a stretch without a line of its own takes the one it lies in."""
    n = image.shape[axis]
    total = np.concatenate([np.zeros_like(np.take(image, [0], axis)), np.cumsum(image, axis)], axis)
    start = np.arange(SIDE) * n // SIDE
    stop = np.maximum((np.arange(SIDE) + 1) * n // SIDE, start + 1)
    size = (stop - start).reshape([-1, 1] if axis == 0 else [1, -1])
    return (np.take(total, stop, axis) - np.take(total, start, axis)) / size


def feature(image: np.ndarray) -> bytes:
    """8 bytes: which low frequencies lie above their median."""
    small = _shrunk(_shrunk(image.astype(np.int64), 1), 0)
    low = (_COSINES @ small @ _COSINES.T).ravel()
    low = np.round(low, 6)  # the same bits whatever the order of the additions
    return np.packbits(low > np.median(low[1:])).tobytes()


def store(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``n_bytes`` of the text and ``media``, the PNG file of its payload."""
    names = [n for n in keep if n not in ("n_bytes", "media")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(len(names)).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:len(names)], pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                 pa.array([write_png(payload(t)) for t in texts], pa.binary())], [*names, "n_bytes", "media"])

    return map_rows(docs.select(*names, text), run, [docs.schema[n] for n in names] + [
        T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])


def read(stored: DataFrame, keep: Sequence[str] = ("doc_id", "n_bytes", "media")) -> DataFrame:
    """The kept columns, ``payload`` (the stored samples) and ``feature`` of every stored file (null: null)."""
    names = [n for n in keep if n not in ("payload", "feature")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            images = [None if m is None else read_png(m) for m in part.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:len(names)], pa.array([None if i is None else i.tobytes() for i in images], pa.binary()),
                 pa.array([None if i is None else feature(i) for i in images], pa.binary())], [*names, "payload", "feature"])

    wide = stored.select(*names, F.col("media").alias("_media"))
    return map_rows(wide, run, [stored.schema[n] for n in names] + [
        T.StructField("payload", T.BinaryType()), T.StructField("feature", T.BinaryType())])
