"""Media columns: documents as lossless WebP images and back, with features of the pixels."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webps
from .common import slices
from .webp import MOST

ROW = 192


def all_to_images(payloads: list[bytes]) -> list[bytes]:
    """Of each payload lossless WebP files, one after another, each of as many rows as an image may have: 64 pixels of three samples to a row.
    Texts of every size are written with all that the format has."""
    samples = [np.frombuffer(x, dtype=np.uint8).reshape(-1, ROW // 3, 3) for x in payloads]
    files = iter(webps.encode_rgb([x[i : i + MOST] for x in samples for i in range(0, len(x), MOST)]))
    return [b"".join(next(files) for _ in range(0, len(x), MOST)) for x in samples]


def all_from_images(stored: list[bytes]) -> list[np.ndarray]:
    """Of each medium the samples (height, 192) of all its images."""
    files, each = [], []
    for x in stored:
        at, n = 0, len(files)
        while at < len(x):
            size = 8 + int.from_bytes(x[at + 4 : at + 8], "little")
            files.append(x[at : at + size])
            at += size
        each.append(len(files) - n)
    rows = (pixels[:, :, :3].reshape(-1, ROW) for pixels in webps.decode(files))
    return [np.concatenate([next(rows) for _ in range(n)]) for n in each]


def to_images(payload: bytes) -> bytes:
    return all_to_images([payload])[0]


def from_images(stored: bytes) -> np.ndarray:
    return all_from_images([stored])[0]


def features(grey: np.ndarray) -> str:
    """Size, mean and standard deviation in thousandths, mean step between rows in thousandths, and a histogram of eight bins, all from whole numbers."""
    n, x = grey.size, grey.astype(np.int64)
    total, square = int(x.sum()), int((x * x).sum())
    step = int(np.abs(np.diff(x, axis=0)).sum()) * 1000 // max(1, grey.size - grey.shape[1])
    bins = np.bincount(grey.reshape(-1) >> 5, minlength=8)
    return f"{grey.shape[1]}x{grey.shape[0]};mean={total * 1000 // n};var={(square * n - total * total) // (n * n)};step={step};hist={','.join(map(str, bins.tolist()))}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (of the UTF-8 text) and media (binary).

    A null text counts as empty; an empty text is stored as one row of spaces.  Texts are padded with spaces to whole rows.
    Repeated rows give equal media, ids pass through, other columns are ignored and an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for part in slices([batch], webps.WRITTEN):
                raw = [(x or "").encode("utf-8", "replace") for x in part.column(1).to_pylist()]
                media = all_to_images([x.ljust(max(1, -(-len(x) // ROW)) * ROW) for x in raw])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def inspect(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the media back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.  A null medium gives nulls."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(media: bytes, grey: np.ndarray) -> tuple:
        payload = grey.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(grey)

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in slices(batches, webps.MANY):
            media = batch.column(2).to_pylist()
            there = [x for x in media if x is not None]
            found = map(one, there, all_from_images(there))
            rows = [(None,) * 6 if x is None else next(found) for x in media]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[id_col, "n_bytes", *names])

    kind = dict(stored.dtypes)[id_col]
    return stored.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
