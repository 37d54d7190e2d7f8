"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), so that all pairwise
interactions cost time linear in the number of features. Inputs come from the text alone: hashed words and hashed
word endings (each block of unit length), bucketed shares of letters, marks, digits and repeats, and bucketed
lengths. Labels, language, source and id are never inputs.

The model is fitted on at most `most` labelled rows (a documented bound; those with the smallest hashes of their
ids), whose features alone come to the driver. Rows with a null label are not used; several labels of one id count
as their rounded mean. Every text is scored whole. A null text is scored as an empty one, a null doc_id is carried
through, repeated rows are scored each, an empty table gives no rows; without any usable label all scores are 0.5.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm import common

WORDS = 1 << 15
EDGES = {
    "upper": [0.005, 0.01, 0.02, 0.03, 0.06, 0.12, 0.25, 0.5],
    "marks": [0.005, 0.015, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "digits": [0.002, 0.01, 0.03, 0.08, 0.2],
    "other": [0.01, 0.03, 0.08, 0.2, 0.4],
    "space": [0.05, 0.1, 0.13, 0.16, 0.2, 0.3],
    "rare_marks": [0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2],
    "word_length": [3, 4, 4.5, 5, 5.5, 6, 7, 8],
    "distinct": [0.05, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9],
    "lines": [0.1, 0.3, 0.5, 0.7, 0.9, 0.999],
    "top_word": [0.02, 0.05, 0.08, 0.12, 0.2, 0.4],
    "n_words": [1, 3, 8, 20, 50, 150, 500, 2000],
    "n_lines": [1, 2, 4, 10, 30, 100],
}
OFFSETS = dict(zip(EDGES, np.cumsum([2 * WORDS, *(len(e) + 1 for e in EDGES.values())]).tolist(), strict=False))
SIZE = 2 * WORDS + sum(len(e) + 1 for e in EDGES.values())
_UPPER, _DIGIT, _SPACE = [np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32))]
_ALNUM = _UPPER | _DIGIT | np.isin(np.arange(256), list(range(97, 123)))
_HIGH = np.arange(256) >= 128
_MARKS = ~(_ALNUM | _SPACE | _HIGH)
_RARE = _MARKS & ~np.isin(np.arange(256), list(b".,'-?;:\""))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a text's features; unique up to hash collisions, which add up."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    counts = Counter(words)
    lines = text.split("\n")
    ends: Counter = Counter()
    for w, c in counts.items():
        ends[w[-2:] + "A" * w.isupper()] += c
    stats = {
        "upper": bytes_[_UPPER].sum() / n, "marks": bytes_[_MARKS].sum() / n, "digits": bytes_[_DIGIT].sum() / n, "other": bytes_[_HIGH].sum() / n,
        "space": bytes_[_SPACE].sum() / n, "rare_marks": bytes_[_RARE].sum() / n, "word_length": len(text) / max(1, len(words)), "distinct": len(counts) / max(1, len(words)),
        "lines": len(set(lines)) / len(lines), "top_word": max(counts.values(), default=0) / max(1, len(words)), "n_words": len(words), "n_lines": len(lines),
    }
    index = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in counts] + [WORDS + zlib.crc32(e.encode("utf-8", "surrogatepass")) % WORDS for e in ends]
    a, b = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts))), np.sqrt(np.fromiter(ends.values(), np.float64, len(ends)))
    value = np.concatenate([a / max(1e-9, np.sqrt((a**2).sum())), b / max(1e-9, np.sqrt((b**2).sum())), np.ones(len(EDGES))])
    index += [OFFSETS[k] + int(np.searchsorted(e, stats[k], side="right")) for k, e in EDGES.items()]
    return np.asarray(index, np.int32), value.astype(np.float32)


class Machine:
    """w0, w (SIZE) and v (SIZE x rank)."""

    def __init__(self, rank: int = 4, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, rank)).astype(np.float32)

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        xv = self.v[index] * value[:, None]
        return float(self.w0 + self.w[index] @ value + 0.5 * ((xv.sum(0) ** 2).sum() - (xv**2).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.02, decay: float = 2e-4, seed: int = 11) -> Machine:
        """Adam on the logistic loss."""
        if not len(rows):
            return self
        rng = np.random.default_rng(seed)
        share = float(np.clip(labels.mean(), 0.01, 0.99))
        self.w0 = float(np.log(share / (1 - share)))
        theta = np.concatenate([self.w[:, None], self.v], 1).astype(np.float64)
        m, s, step, m0, s0 = np.zeros_like(theta), np.zeros_like(theta), 0, 0.0, 0.0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(rows), batch):
                own = order[lo : lo + batch]
                index, value = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own]).astype(np.float64)
                row = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
                t = theta[index]
                xv = t[:, 1:] * value[:, None]
                sums = np.stack([np.bincount(row, xv[:, f], len(own)) for f in range(xv.shape[1])], 1)
                z = self.w0 + np.bincount(row, t[:, 0] * value, len(own)) + 0.5 * ((sums**2).sum(1) - np.bincount(row, (xv**2).sum(1), len(own)))
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) / len(own)
                e = error[row] * value
                used, at = np.unique(index, return_inverse=True)
                parts = [e, *((sums[row, f] - xv[:, f]) * e for f in range(xv.shape[1]))]
                grad = np.stack([np.bincount(at, p, len(used)) for p in parts], 1) + decay * theta[used]
                step += 1
                m[used] = 0.9 * m[used] + 0.1 * grad
                s[used] = 0.99 * s[used] + 0.01 * grad**2
                theta[used] -= rate * (m[used] / (1 - 0.9 ** min(step, 500))) / (np.sqrt(s[used] / (1 - 0.99 ** min(step, 5000))) + 1e-6)
                g0 = float(error.sum())
                m0, s0 = 0.9 * m0 + 0.1 * g0, 0.99 * s0 + 0.01 * g0**2
                self.w0 -= rate * m0 / (np.sqrt(s0) + 1e-6)
        self.w, self.v = theta[:, 0].astype(np.float32), theta[:, 1:].astype(np.float32)
        return self


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000) -> Machine:
    """A machine fitted on at most `most` labelled rows outside the held-out share."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.round(F.avg(F.col("quality").cast("double"))).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(x) for x in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], names=["doc_id", "label", "index", "value"])

        return work

    texts = texts.select(F.col("doc_id").cast("long"), F.col("label").cast("double"), "text")
    rows = sorted(common.map_batches(texts, ["doc_id", "label", "text"], make, "doc_id long, label double, index binary, value binary").collect())
    return Machine().fit([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows], np.array([r[1] for r in rows]))


def score(docs: DataFrame, machine: Machine, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The kept columns of docs (doc_id alone by default) and the score of every text in a column `out`."""
    keep = keep or ["doc_id"]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, T.DoubleType())])

    def make():
        def work(batch: pa.RecordBatch) -> pa.Table:
            found = []
            for text in batch.column(batch.num_columns - 1):
                z = machine.raw(*features(text.as_py()))
                found.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[*batch.schema.names[:-1], out])

        return work

    return common.map_batches(docs.select(*keep, F.col("text").alias("_folioscope_text")), ["*"], make, schema)
