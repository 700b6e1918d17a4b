"""Media columns on Spark: byte payloads stored as lossless WebP files, files read back as pixel arrays and features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm import webp

#: A payload is a positive multiple of so many bytes, filled with the byte after it; bytes that are coded together.
UNIT, FILL, BATCH_BYTES = 3 * webp.WIDTH, b" ", 6_000_000


def padded(data: bytes) -> bytes:
    return data + FILL * ((-len(data)) % UNIT if data else UNIT)


def _parts(values: list[bytes], most: int) -> Iterator[list[bytes]]:
    """The values in order, in lists of at most ``most`` bytes or a single value."""
    part: list[bytes] = []
    size = 0
    for v in values:
        if part and size + len(v) > most:
            yield part
            part, size = [], 0
        part.append(v)
        size += len(v)
    if part:
        yield part


def store(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, n_bytes (of the text as UTF-8) and media (binary): the text, filled up to UNIT bytes, as a WebP file.

    Null text: as the empty text, which is stored as UNIT fill bytes. Null ident and rows that repeat: a result each.
    Texts of over 12,288 bytes become animations with a frame for each 64 rows. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.as_py() or b"" for v in batch.column(1).cast(pa.large_binary())]
            at = 0
            for part in _parts(texts, BATCH_BYTES):
                media = webp.encode([padded(t) for t in part])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([len(t) for t in part], pa.int64()), pa.array(media, pa.binary())], names=[ident, "n_bytes", "media"])
                at += len(part)

    return docs.select(F.col(ident), F.col(text)).mapInArrow(run, f"`{ident}` {docs.schema[ident].dataType.simpleString()}, n_bytes long, media binary")


def pixels(rows: DataFrame, media: str = "media") -> DataFrame:
    """``rows`` with width, height, frames (int; of the first frame's size, and how many) and pixels (binary, ARGB of
    each frame in turn as little-endian uint32). Null media: nulls. Bytes that are no lossless WebP file fail."""
    kept = rows.drop("width", "height", "frames", "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(media)).to_pylist()
            found: list = []
            for part in _parts([v for v in values if v is not None], BATCH_BYTES):
                found.extend(webp.decode(part))
            images = iter(found)
            each = [None if v is None else next(images) for v in values]
            of = lambda get: [None if x is None else get(x) for x in each]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(of(lambda x: x[0][0]), pa.int32()), pa.array(of(lambda x: x[0][1]), pa.int32()), pa.array(of(len), pa.int32()),
                pa.array(of(lambda x: b"".join(f[2].astype("<u4").tobytes() for f in x)), pa.binary()),
            ], names=[*batch.schema.names, "width", "height", "frames", "pixels"])

    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", width int, height int, frames int, pixels binary")


def payload_features(stored: DataFrame, ident: str = "doc_id") -> DataFrame:
    """What store() made, read back: payload and media digests and a feature string, a row for each row.

    The feature string has frames, width and rows, the means of red, green and blue in thousandths, the number of
    different byte values, and the share of pixels like the one to their left, in thousandths.
    """
    names = [ident, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, rows = batch.column(2).to_pylist(), []
            for part in _parts(media, BATCH_BYTES):
                for file, frames in zip(part, webp.decode(part), strict=True):
                    argb = np.concatenate([f[2] for f in frames])
                    rgb = np.empty((len(argb), 3), np.uint8)
                    for k, shift in enumerate((16, 8, 0)):
                        rgb[:, k] = argb >> np.uint32(shift) & np.uint32(255)
                    data = rgb.tobytes()
                    sums = rgb.sum(0, dtype=np.int64).tolist()
                    alike = int(np.count_nonzero(argb[1:] == argb[:-1]))
                    kinds = int(np.count_nonzero(np.bincount(rgb.reshape(-1), minlength=256)))
                    feature = f"frames={len(frames)};width={frames[0][0]};rows={len(argb) // frames[0][0]};mean={','.join(str(1000 * s // len(argb)) for s in sums)};kinds={kinds};alike={1000 * alike // len(argb)}"
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    kind = stored.schema[ident].dataType.simpleString()
    return stored.select(ident, "n_bytes", "media").mapInArrow(run, f"`{ident}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
