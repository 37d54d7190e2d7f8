"""Media columns: byte payloads stored as lossless WebP files and read back as pixel arrays.

A payload fills rows of 64 RGB pixels (192 bytes) and is stored as the pixels of one VP8L file; payloads of more than
16384 rows go on in files of their own, one after another, each with its own RIFF length. Every text is stored whole.

A null text is empty; an empty payload is padded to 192 bytes. A null doc_id is carried through, repeated rows are
stored each, equal texts give equal files, an empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import common, webp

ROW = 192
MOST_ROWS = 16384
LEVELS = np.arange(0, 768, 256)
SQUARES = np.stack([np.arange(256), np.arange(256) ** 2], 1)


def to_files(payload: bytes) -> bytes:
    """The WebP files, one after another, of a payload that is a positive multiple of ROW bytes."""
    out = []
    for lo in range(0, len(payload), ROW * MOST_ROWS):
        x = np.frombuffer(payload[lo : lo + ROW * MOST_ROWS], np.uint8).reshape(-1, ROW // 3, 3).astype(np.uint32)
        out.append(webp.encode_smallest(0xFF000000 | x[..., 0] << 16 | x[..., 1] << 8 | x[..., 2]))
    return b"".join(out)


def to_pixels(files: bytes) -> list[np.ndarray]:
    """The pixel arrays (rows, columns, RGB bytes) of files that stand one after another."""
    out, at = [], 0
    while at < len(files):
        end = at + 8 + int.from_bytes(files[at + 4 : at + 8], "little")
        argb = webp.decode(files[at:end])
        out.append(np.stack([argb >> 16, argb >> 8, argb], -1).astype(np.uint8))
        at = end
    return out


def feature(pixels: np.ndarray) -> str:
    """Size, mean and spread of each channel in thousandths, a 16-bin histogram, and an 8 x 8 average hash of the brightness."""
    n = pixels.shape[0] * pixels.shape[1]
    flat = pixels.reshape(-1, 3)
    counts = np.bincount((flat + LEVELS).reshape(-1), minlength=768).reshape(3, 256)
    sums, squares = (counts @ SQUARES[:, 0]).tolist(), (counts @ SQUARES[:, 1]).tolist()
    stats = ",".join(f"{1000 * s // n}/{1000 * (n * q - s * s) // (n * n)}" for s, q in zip(sums, squares, strict=True))
    histogram = ",".join(map(str, counts.sum(0).reshape(16, 16).sum(1).tolist()))
    grey = pixels.sum(-1, dtype=np.int64)
    rows = [b for b in np.array_split(np.arange(grey.shape[0]), 8) if len(b)]
    cells = np.array([grey[b[0] : b[-1] + 1].sum(0).reshape(8, 8).sum(1) * 8 // len(b) for b in rows])
    bits = "".join("1" if x * cells.size > cells.sum() else "0" for x in cells.reshape(-1).tolist())
    return f"{pixels.shape[1]}x{pixels.shape[0]};{stats};{histogram};{int(bits, 2):x}"


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with spaces, as lossless WebP."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, files = [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                files.append(to_files(raw + b" " * (-len(raw) % ROW if raw else ROW)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

        return work

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], make, "doc_id long, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Adds to (doc_id, n_bytes, media) the payload, which is the decoded pixels' bytes, and a feature of the pixels."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            payloads, features = [], []
            for files in batch.column(2):
                parts = to_pixels(files.as_py())
                payloads.append(b"".join(p.tobytes() for p in parts))
                features.append(feature(parts[0] if len(parts) == 1 else np.concatenate(parts)))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string())], names=["doc_id", "n_bytes", "media", "payload", "feature"])

        return work

    return common.map_batches(stored, ["doc_id", "n_bytes", "media"], make, "doc_id long, n_bytes long, media binary, payload binary, feature string")
