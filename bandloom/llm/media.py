"""Media columns: text payloads as progressive JPEG, decoded to coefficients, payload and RGB tensor."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import byte_slices

#: Bytes of text or media coded side by side; a larger one goes alone.
BATCH = 3_000_000


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, n_bytes, media)``: each text's UTF-8 bytes, filled with zeros to a positive multiple of 64, as a JPEG.

    A null text counts as empty, and an empty one is one block of zeros. Equal texts have equal media;
    repeated rows stay repeated; a null id is kept; an empty table gives no rows; extra columns are
    ignored. The payload is held losslessly, as coefficients.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1), BATCH):
                part = [(t or "").encode() for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                media = jpeg.encode([x + bytes(-len(x) % 64 if x else 64) for x in part])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in part], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def payload_of(image: jpeg.Image, coefs: list[np.ndarray]) -> bytes:
    """The payload that ``jpeg.encode`` put into an image."""
    told, _, ranked = image.comment.removeprefix(b"bytes:").partition(b";")
    flat = np.concatenate(coefs).reshape(-1)[: int(told)].astype(np.int64)
    return np.frombuffer(ranked, np.uint8)[2 * np.abs(flat) - (flat > 0)].tobytes()


def decode_media(df: DataFrame, id_col: str = "id", media_col: str = "media", with_tensor: bool = False) -> DataFrame:
    """Read media back: ``(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, height, width[, payload, tensor])``.

    ``feature`` is the image's size, mean and spread of each colour over the full-resolution tensor
    and the tensor's CRC-32; all come from integer sums. ``tensor`` holds height x width x 3 samples.
    A null medium gives nulls; a broken one fails with its reason; equal media give equal values; an
    empty table gives no rows; extra columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    if with_tensor:
        names, kinds = [*names, "payload", "tensor"], [*kinds, pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(2), BATCH):
                media = batch.column(2).slice(lo, hi - lo).to_pylist()
                at = [i for i, m in enumerate(media) if m is not None]
                images = [jpeg.parse(media[i]) for i in at]
                rows: list[tuple] = [(None,) * len(names)] * len(media)
                found = jpeg.decode(images)
                for i, image, coefs, pixels in zip(at, images, found, jpeg.samples(images, found), strict=True):
                    payload, tensor = payload_of(image, coefs), jpeg.rgb(image, pixels)
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media[i]), hashlib.sha256(media[i]).hexdigest(), feature(tensor), image.height, image.width)
                    rows[i] = (*row, payload, tensor.tobytes()) if with_tensor else row
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *cols], names=["id", "n_bytes", *names])

    sql = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join([f"id {kind}", "n_bytes long", *[f"{n} {sql[k]}" for n, k in zip(names, kinds, strict=True)]])
    return df.select(F.col(id_col).alias("id"), F.col("n_bytes"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def feature(tensor: np.ndarray) -> str:
    """Size, mean and standard deviation of each colour, and CRC-32 of a tensor, as text."""
    flat = tensor.reshape(-1, 3)
    n, told = len(flat), []
    for c in range(3):
        seen = np.bincount(flat[:, c], minlength=256)
        total, square = int(seen @ np.arange(256)), int(seen @ np.arange(256) ** 2)
        told.append(f"{total / n:.4f},{max(0.0, square / n - (total / n) ** 2) ** 0.5:.4f}")
    return f"{tensor.shape[0]}x{tensor.shape[1]};{';'.join(told)};{zlib.crc32(tensor.tobytes()):08x}"
