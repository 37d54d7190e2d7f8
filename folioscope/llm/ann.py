"""Approximate nearest neighbours by multi-index hashing.

Fitting: a rotation learnt on a bounded sample (principal axes, then alternating Procrustes steps towards binary codes)
gives each vector a code of `bits` sign bits. The exact neighbours of `queries` sample vectors among all rows, found in
one pass over the whole index, give the search radius: the Hamming distance within which `cover` of them lie. Both bounds
are documented parameters; every row is indexed.

Index: a code is split into m substrings of `width` bits (16, or 8 for tables too small to fill 16), and each (substring,
value) is a bucket. Buckets in the order of their values are dealt out to parts of about PART entries by their exact
counts, a bucket above that to several parts by a hash of the row, so no part grows with the data or with a hot value. A
row goes, with its vector, to each part that holds one of its m buckets.

Search: a code within radius R of the query differs in at most floor(R / m) bits in one of the first R mod m + 1
substrings, or in one bit less in one of the others. A query goes to the parts that hold a value so near to its own; there
the entries of those buckets are retrieved, those within Hamming radius R reranked by exact Euclidean distances in double
precision, and the k best leave the part. Rows and queries meet by the part's number in one exchange: neither passes
through the driver, and a task holds one part at a time. Only the counts of buckets (at most 2**18) reach the driver.
Queries that find fewer than k rows in all of the index are compared with every row (each part of the first substring).

How much of the index a query touches follows from the radius: a sliver for clustered vectors, up to all of it for
vectors without structure, whose neighbours are hardly nearer than the rest.

Rows with null, zero or wrong-length vectors, or with null or non-finite components take no part (the length is the
most frequent one); null ids neither. Repeated ids are rows of their own; a query leaves out all rows of its id, and
repeated rows of a query are one query. Ties go to the smaller id. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import common

PART = 32768
FOUND = "query_id long, query_row long, vec_id long, row long, squared double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    e = F.col("embedding")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull())
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.where(~bad & F.exists("embedding", lambda x: x != 0))
    length = own.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.where(F.size("embedding") == (length["n"] if length else -1))


class Codes:
    """A mean and a rotation (dimensions x bits) that give vectors their codes."""

    def __init__(self, sample: np.ndarray, bits: int = 64, rounds: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.bits, self.mean = bits, sample.mean(0)
        centred = sample - self.mean
        turns = []
        for lo in range(0, bits, d):
            n = min(d, bits - lo)
            _, _, axes = np.linalg.svd(centred.T @ centred)
            axes = axes[:n].T
            turn, _ = np.linalg.qr(rng.normal(size=(n, n)))
            flat = centred @ axes
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
                turn = (u @ v).T
            turns.append(axes @ turn)
        self.turn = np.concatenate(turns, 1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as bytes."""
        return np.packbits((x - self.mean) @ self.turn >= 0, axis=1)


def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of codes given as bytes."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def reaches(radius: int, m: int) -> np.ndarray:
    """By substring, in how many bits a code within the radius may differ there, by the pigeonhole principle; -1: none is asked."""
    low, over = divmod(radius, m)
    return np.array([low if i <= over else low - 1 for i in range(m)])


class Layout:
    """Which parts hold a bucket: parts of about `most` entries, cut in the order of substrings and values."""

    def __init__(self, width: int, counts: np.ndarray, most: int = PART):
        """counts: entries by substring and value."""
        self.width, self.m, self.filled = width, len(counts), counts > 0
        self.first, self.pieces = np.zeros(counts.shape, np.int64), np.ones(counts.shape, np.int64)
        self.all_values = np.arange(counts.shape[1], dtype=np.uint32)
        self.parts, self.first_table = 0, 0  # how many there are, and how many hold the first substring's buckets
        for i in range(self.m):
            fill = most + 1  # each substring begins a part
            for v in np.flatnonzero(counts[i]).tolist():
                c = int(counts[i, v])
                if fill + c > most:
                    self.parts, fill = self.parts + 1, 0
                self.first[i, v] = self.parts - 1
                fill += c
                if c > most:
                    self.pieces[i, v] = -(-c // most)
                    self.parts += int(self.pieces[i, v]) - 1
                    fill = most + 1
            self.first_table = self.first_table or self.parts

    def values(self, codes: np.ndarray) -> np.ndarray:
        """The substrings of codes (rows, m)."""
        return codes if self.width == 8 else np.ascontiguousarray(codes).view(np.uint16)

    def parts_of_row(self, values: np.ndarray, row: int) -> list[int]:
        i = np.arange(self.m)
        return np.unique(self.first[i, values] + row % self.pieces[i, values]).tolist()

    def parts_of_query(self, values: np.ndarray, reach: np.ndarray) -> list[int]:
        asked = np.zeros(self.parts + 1, np.int64)
        for i in np.flatnonzero(reach >= 0).tolist():
            near = self.filled[i] & (np.bitwise_count(self.all_values ^ np.uint32(values[i])) <= reach[i])
            np.add.at(asked, self.first[i][near], 1)
            np.add.at(asked, (self.first[i] + self.pieces[i])[near], -1)
        return np.flatnonzero(np.cumsum(asked)[:-1] > 0).tolist()


class Part:
    """The rows of one part and the entries of its buckets."""

    def __init__(self, layout: Layout, number: int, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.layout, self.ids, self.rows, self.vectors, self.codes = layout, ids, rows, vectors, codes
        self.norms = np.einsum("ij,ij->i", vectors, vectors)
        values = layout.values(codes)
        self.entries = []
        for i in range(layout.m):
            own = values[:, i].astype(np.int64)
            held = np.flatnonzero(layout.first[i, own] + rows % layout.pieces[i, own] == number)
            order = held[np.argsort(own[held], kind="stable")]
            found, starts = np.unique(own[order], return_index=True)
            self.entries.append((order, found.astype(np.uint32), np.append(starts, len(order))))

    def within(self, code: np.ndarray, radius: int, reach: np.ndarray) -> np.ndarray:
        """Rows of near buckets whose codes lie within the radius."""
        mine, held = self.layout.values(code[None])[0], np.zeros(len(self.ids), bool)
        for i, (order, found, starts) in enumerate(self.entries):
            if reach[i] < 0 or not len(order):
                continue
            near = np.bitwise_count(found ^ np.uint32(mine[i])) <= reach[i]
            held[order[np.repeat(near, np.diff(starts))]] = True
        rows = np.flatnonzero(held)
        return rows[far(self.codes[rows], code) <= radius]

    def nearest(self, rows: np.ndarray, query: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The `most` nearest of the rows and their squared distances, ties to the smaller id."""
        if len(rows) > most:
            # Rough distances first; those that rounding could bring among the nearest are measured exactly.
            products = (self.vectors @ query)[rows] if 4 * len(rows) > len(self.ids) else self.vectors[rows] @ query
            rough = self.norms[rows] - 2 * products
            edge = np.partition(rough, most - 1)[most - 1]
            rows = rows[rough <= edge + 1e-9 * (1 + abs(edge) + float(query @ query))]
        squared = ((self.vectors[rows] - query) ** 2).sum(1)
        order = np.lexsort((self.ids[rows], squared))[:most]
        return rows[order], squared[order]


def _matrix(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def radius_of(index: DataFrame, sample: np.ndarray, ids: np.ndarray, codes: Codes, k: int, cover: float) -> int:
    """The Hamming distance within which `cover` of the sample's exact k nearest rows among the whole index lie."""
    own = codes.encode(sample)

    def run(batches):
        best = np.full((len(sample), k), np.inf)
        bits = np.zeros((len(sample), k), np.int64)
        for batch in batches:
            x, code, vec_ids = _matrix(batch.column(2), np.float64), _matrix(batch.column(3), np.uint8), batch.column(0).to_numpy()
            rough = (x * x).sum(1)[None] - 2 * sample @ x.T + (sample * sample).sum(1)[:, None]
            rough[ids[:, None] == vec_ids[None]] = np.inf
            for q in range(len(sample)):
                near = np.argpartition(rough[q], k - 1)[:k] if len(x) > k else np.arange(len(x))
                both, far_off = np.concatenate([best[q], rough[q][near]]), np.concatenate([bits[q], far(code[near], own[q])])
                first = np.argsort(both, kind="stable")[:k]
                best[q], bits[q] = both[first], far_off[first]
        q, place = np.nonzero(best < np.inf)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(best[q, place]), pa.array(bits[q, place])], names=["q", "d", "bits"])

    found = index.mapInArrow(run, "q long, d double, bits long")
    first = F.row_number().over(Window.partitionBy("q").orderBy("d", "bits"))
    seen = found.withColumn("n", first).where(F.col("n") <= k).select("bits").toPandas()["bits"]  # at most k for each sample query
    return int(np.quantile(seen, cover, method="higher")) if len(seen) else codes.bits


def search(vectors: DataFrame, is_query: F.Column, k: int = 10, most_sample: int = 8192, bits: int = 64, cover: float = 0.975, queries: int = 256, part: int = PART) -> DataFrame:
    """Per query its k nearest found: query_id, rank, vec_id, score (the distance)."""
    spark = vectors.sparkSession
    own = usable(vectors)
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_sample).toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.array(sample["embedding"].tolist())
    codes = Codes(x, bits=bits)

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in codes.encode(x)], pa.binary())], names=["vec_id", "row", "vector", "code"])

    numbered = own.select("vec_id", "embedding", F.monotonically_increasing_id().alias("row"))
    index = common.stored(numbered.mapInArrow(encode, "vec_id long, row long, vector binary, code binary"), "mih-index")
    radius = radius_of(index, x[:queries], sample["vec_id"].to_numpy()[:queries], codes, k, cover)
    width = 16 if index.count() >= 1 << 14 and bits % 16 == 0 else 8
    m = bits // width
    reach = reaches(radius, m)
    bucket = [F.conv(F.hex(F.expr(f"substring(code, {i * width // 8 + 1}, {width // 8})")), 16, 10).cast("int") for i in range(m)]
    counts = np.zeros((m, 1 << width), np.int64)
    # The bytes of a substring stand in the order of the machine, lowest first.
    for r in index.select(F.posexplode(F.array(*bucket)).alias("i", "v")).groupBy("i", "v").count().toLocalIterator():
        v = r["v"] if width == 8 else int.from_bytes(r["v"].to_bytes(2, "big"), "little")
        counts[r["i"], v] = r["count"]
    layout = Layout(width, counts, part)

    asked = index.where(is_query).dropDuplicates(["vec_id", "vector"])
    found = common.stored(_meet(index, asked, layout, radius, reach, k), "mih-found")
    by_query = found.groupBy("query_row").agg(F.count_distinct("row").alias("n"))
    short = asked.join(by_query.withColumnRenamed("query_row", "row"), "row", "left").where(F.coalesce("n", F.lit(0)) < k).select(*asked.columns)
    short = common.stored(short, "mih-short")
    if not short.isEmpty():
        whole = _meet(index, short, layout, bits, np.array([width] + [-1] * (m - 1)), k)
        found = found.union(whole)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("squared", "vec_id", "row"))
    best = found.dropDuplicates(["query_row", "row"]).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", F.sqrt("squared").alias("score"))


def _meet(index: DataFrame, asked: DataFrame, layout: Layout, radius: int, reach: np.ndarray, k: int) -> DataFrame:
    """Per query and part the k nearest rows (FOUND) that the part's near buckets hold within the radius."""
    used = layout.parts if (reach[1:] >= 0).any() else layout.first_table

    def dealt(is_query: bool):
        def run(batches):
            for batch in batches:
                values, rows = layout.values(_matrix(batch.column(3), np.uint8)), batch.column(1).to_pylist()
                parts = [layout.parts_of_query(v, reach) if is_query else [p for p in layout.parts_of_row(v, r) if p < used] for v, r in zip(values, rows, strict=True)]
                at = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]), pa.int64())
                number = pa.array([p for own in parts for p in own], pa.int64())
                yield pa.RecordBatch.from_arrays([number, pa.array([is_query] * len(number)), *[c.take(at) for c in batch.columns]], names=["part", "is_query", "vec_id", "row", "vector", "code"])

        return run

    schema = "part long, is_query boolean, vec_id long, row long, vector binary, code binary"
    both = index.mapInArrow(dealt(False), schema).union(asked.mapInArrow(dealt(True), schema))
    both = both.repartition(F.col("part")).sortWithinPartitions("part", "is_query")

    def run(batches):
        number, rows, held, found = None, [], None, []
        for batch in batches:
            parts, is_query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)], strict=True):
                if hi <= lo:
                    continue
                own = batch.slice(lo, hi - lo)
                if parts[lo] != number:
                    number, rows, held = parts[lo], [], None
                if not is_query[lo]:
                    rows.append(own)
                    continue
                if held is None and rows:
                    columns = pa.Table.from_batches(rows)
                    held = Part(layout, int(number), columns["vec_id"].to_numpy(), columns["row"].to_numpy(), _matrix(columns["vector"], np.float64), _matrix(columns["code"], np.uint8))
                    rows = []
                if held is None:
                    continue
                for q, q_row, vector, code in zip(*(own.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True):
                    at = held.within(np.frombuffer(code, np.uint8), radius, reach)
                    at, squared = held.nearest(at[held.ids[at] != q], np.frombuffer(vector, np.float64), k)
                    found += [(q, q_row, int(i), int(r), float(d)) for i, r, d in zip(held.ids[at], held.rows[at], squared, strict=True)]
                if found:
                    columns = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.float64())], names=["query_id", "query_row", "vec_id", "row", "squared"])
                    found = []

    return both.mapInArrow(run, FOUND)
