"""Order-preserving packing: dynamic programming over window cuts with a monotone queue.

Documents stay in the order of their partition. A sequence is a run of at most `window` tokens between two
cuts; cuts may stand after a document (free), after a sentence (sentence_penalty tokens) or, where neither
comes for a long time, on a grid (hard_penalty tokens). The cost of a sequence is its padding, none if its
length is a power of two (from `shortest` up, 1 by default; more keeps sequences long at the price of padding); the
sum of padding and penalties is minimal over each stretch of SEGMENT windows. Of equal costs the longest sequence
that the queue holds is taken, so a run gives the same cuts again.

Nulls: a null text is empty and gives the end id alone; a null doc_id is carried through. Repeated rows are
packed one by one. Very long texts are cut like others, and the newest one is held whole. Empty tables give no rows.
Other columns of the input are ignored.

Sequences never span partitions, so nothing is shuffled and each task holds one stretch of documents. The
numbering is sequence_id = partition * 2**32 + running number: a lost task gives the same rows again because
a file scan deals the same rows to the same partition.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from folioscope.llm import common
from folioscope.llm.tokens import Encoder

SEGMENT = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_ends(encoder: Encoder, text: str) -> tuple[bytes, list[int]]:
    """The ids of a text and the numbers of ids after which a sentence ends."""
    found = encoder.words(text)
    if found:
        words, ids = found
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) >> 2
        at = [i for i, w in enumerate(words) if w[-1] in ".!?\n"]
        return b"".join(ids), ends[at].tolist() if at else []
    if not text:
        return b"", []
    got = encoder.tokenizer.encode(text, add_special_tokens=False)
    return np.asarray(got.ids, "<u4").tobytes(), [i + 1 for i, (_, e) in enumerate(got.offsets) if e < len(text) and text[e - 1] in ".!?\n" and text[e].isspace()]


def best_cuts(pos: list[int], pen: list[float], window: int, shortest: int = 1) -> list[int]:
    """Indexes of the cuts, first and last included, with the least padding plus penalties.

    pos rises from pos[0]; no two neighbours are more than window apart.
    """
    total = [0.0] * len(pos)
    came = [0] * len(pos)
    key = [0.0] * len(pos)
    key[0] = pos[0]
    queue = deque([0])
    # By cut, the cuts that stand a power of two before it: a sequence between them has no padding.
    free: dict[int, list[int]] = {}
    places = np.asarray(pos)
    for power in (1 << k for k in range(window.bit_length()) if shortest <= 1 << k < window):
        before = np.searchsorted(places, places - power)
        for j in np.flatnonzero(places[before] == places - power).tolist():
            free.setdefault(j, []).append(int(before[j]))
    for j in range(1, len(pos)):
        p = pos[j]
        while p - pos[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        cost = key[i] + window - p
        if j in free:
            for k in free[j]:
                if total[k] < cost:
                    cost, i = total[k], k
        cost += pen[j]
        total[j], came[j], key[j] = cost, i, cost + p
        k = cost + p
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out = [len(pos) - 1]
    while out[-1]:
        out.append(came[out[-1]])
    return out[::-1]


class Packer:
    """Documents in, pieces of finished sequences out; holds one stretch of SEGMENT windows and the newest document."""

    def __init__(self, encoder: Encoder, window: int, sentence_penalty: float, hard_penalty: float, end_id: int, first: int, with_ids: bool, shortest: int = 1):
        self.encoder, self.window, self.soft, self.hard, self.next, self.with_ids, self.shortest = encoder, window, sentence_penalty, hard_penalty, first, with_ids, shortest
        self.end = np.asarray([end_id], "<u4").tobytes()
        self.docs: list[tuple[int | None, bytes]] = []
        self.starts: list[int] = []  # of the documents, in tokens of the stretch; may be negative for one begun earlier
        self.pos, self.pen = [0], [0.0]
        self.out: list[list] = [[] for _ in range(8)]

    def add(self, doc_id: int | None, text: str | None) -> None:
        ids, ends = sentence_ends(self.encoder, text or "")
        ids += self.end
        base, n, step = self.pos[-1], len(ids) >> 2, max(1, self.window // 8)
        self.docs.append((doc_id, ids))
        self.starts.append(base)
        last = 0
        for e in [*ends, n]:
            if e <= last or (e >= n and e != n):
                continue
            while e - last > step:
                last += step
                self.pos.append(base + last)
                self.pen.append(self.hard)
            last = e
            self.pos.append(base + e)
            self.pen.append(self.soft)
        self.pen[-1] = 0.0
        if self.pos[-1] > SEGMENT * self.window:
            self.flush(False)

    def flush(self, final: bool) -> None:
        if len(self.pos) < 2:
            return
        cuts = best_cuts(self.pos, self.pen, self.window, self.shortest)
        if not final:
            cuts = cuts[:-1]  # the last, part-filled window goes on with the next stretch
        for a, b in zip(cuts, cuts[1:], strict=False):
            self.emit(self.pos[a], self.pos[b])
        keep = cuts[-1]
        shift, first = self.pos[keep], max(0, bisect_right(self.starts, self.pos[keep]) - 1)
        if final:
            first = len(self.docs)
        self.docs, self.starts = self.docs[first:], [s - shift for s in self.starts[first:]]
        self.pos, self.pen = [p - shift for p in self.pos[keep:]], self.pen[keep:]

    def emit(self, a: int, b: int) -> None:
        k = max(0, bisect_right(self.starts, a) - 1)
        while k < len(self.docs) and self.starts[k] < b:
            doc_id, ids = self.docs[k]
            lo, hi = max(a, self.starts[k]), min(b, self.starts[k] + (len(ids) >> 2))
            if hi > lo:
                own = ids[(lo - self.starts[k]) << 2 : (hi - self.starts[k]) << 2]
                row = (doc_id, lo - self.starts[k], hi - lo, zlib.crc32(own), len(ids) >> 2, self.next, lo - a, own if self.with_ids else None)
                for column, x in zip(self.out, row, strict=True):
                    column.append(x)
            k += 1
        self.next += 1

    def take(self) -> pa.RecordBatch | None:
        if not self.out[0]:
            return None
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array(x, pa.int64()) for x in self.out[:7]]
        if self.with_ids:
            names, arrays = [*names, "ids"], [*arrays, pa.array(self.out[7], pa.binary())]
        self.out = [[] for _ in range(8)]
        return pa.RecordBatch.from_arrays(arrays, names=names)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, sentence_penalty: float = 4.0, hard_penalty: float = 48.0, end_id: int = 1, with_ids: bool = True, shortest: int = 1) -> DataFrame:
    """Pieces of all documents (doc_id, text); with_ids adds the pieces' ids as little-endian 32-bit bytes."""

    def run(batches):
        encoder = common.worker_cache(("encoder", tokenizer), lambda: Encoder(tokenizer))
        packer = Packer(encoder, window, sentence_penalty, hard_penalty, end_id, TaskContext.get().partitionId() << 32, with_ids, shortest)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, text.as_py())
                if len(packer.out[0]) >= 2000:
                    yield packer.take()
        packer.flush(True)
        if (last := packer.take()) is not None:
            yield last

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(common.tidy(run), SCHEMA + (", ids binary" if with_ids else ""))
