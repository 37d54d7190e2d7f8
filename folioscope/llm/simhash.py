"""SimHash near-dedup: fingerprints of word shingles, linked through BK-trees over shards of near candidates.

Fingerprints within `radius` bits agree in at least five-less-radius of five blocks (two of five for radius 3), so
each distinct fingerprint goes to one shard for every pair of blocks; every link lies in one of those shards, whatever
else they hold. A shard builds a BK-tree (children keyed by their Hamming distance to the parent) and each fingerprint
follows only edges within the radius. A shard above MOST fingerprints is split by four pieces of the bits that its
members need not share, one of which any linked pair agrees in; what is still above MOST is dealt out as trees of at most
MOST, each shipped to the pieces of the same shard: no tree grows with the data, and none passes through the driver. A
shard returns a spanning forest of its links, which joins the same fingerprints as all its links would.

survivors(), the pipeline's stage, links texts by the exact Jaccard similarity of their sets of five-word shingles, 0.8 or
more. Pairs of 0.8 lie about 10 bits apart, too far for blocks of 64 bits, so candidates come from bands of minima of
the shingles' hashes besides the links above. Each component of candidates is compared pair by pair, a large one as
pairs of trees as above; texts without words are alike.

Components come from alternating large-star and small-star steps on those edges, cut by written tables.

Nulls and empty texts have fingerprint 0 and are linked like any other; repeated rows are members one by one; a null
doc_id stays null and never is a component's smallest id. Very long texts are hashed whole, in pieces. Ties between rows
of one fingerprint or text go to the smaller doc_id. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm import common

BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
RADIUS = 3
MOST = 1024
# The pipeline's stage: words a shingle, least similarity, and bands of so many minima. A pair at 0.8 shares none of the bands with probability (1 - 0.8 ** 5) ** 30, 7 in a million.
SHINGLE, SIMILAR, BANDS, BAND = 5, 0.8, 30, 5
FACTORS, TERMS = (np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * BAND), np.uint64) | np.array([[1], [0]], np.uint64))


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 hashes with seed 42 of a text's lower-cased word shingles, in order; a shorter text is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z alone, and white space is 9-13 and 32
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    return np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text's shingles."""
    h = shingles(text, shingle)
    if not (n := len(h)):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        part = h[lo : lo + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row; fp holds the 64 bits as a signed number."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=["doc_id", "fp"])

        return work

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], make, "doc_id long, fp long")


class BKTree:
    """Nodes with children keyed by Hamming distance; find() follows edges within the radius only."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if (at := len(self.values) - 1) == 0:
            return
        node = 0
        while True:
            d = (self.values[node] ^ value).bit_count()
            child = self.children[node].get(d)
            if child is None:
                self.children[node][d] = at
                return
            node = child

    def find(self, value: int, radius: int) -> list[int]:
        """The numbers of the nodes within the radius."""
        found, stack = [], [0] if self.values else []
        while stack:
            node = stack.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            kids = self.children[node]
            if len(kids) <= 2 * radius + 1:
                stack += [c for e, c in kids.items() if d - radius <= e <= d + radius]
            else:
                stack += [kids[e] for e in range(max(0, d - radius), d + radius + 1) if e in kids]
        return found


def forest(tree_values: list[int], probes: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among tree_values and between them and the probes."""
    tree, parent = BKTree(), list(range(len(tree_values) + len(probes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []

    def join(i: int, value: int) -> None:
        for j in tree.find(value, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                edges.append((value, tree.values[j]))

    for i, value in enumerate(tree_values):
        join(i, value)
        tree.add(value)
    for i, value in enumerate(probes):
        join(len(tree_values) + i, value)
    return edges


def _packed(blocks, fp: F.Column) -> F.Column:
    """The bits of some blocks as one number."""
    out = F.lit(0).cast("long")
    for at, bits in blocks:
        out = F.shiftleft(out, bits).bitwiseOR(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    return out


def shards(distinct: DataFrame) -> DataFrame:
    """(fp, shard): each fingerprint in a shard for every pair of blocks; the rows of a large shard in four smaller ones instead.

    Two linked fingerprints of a shard differ in at most three of the other blocks' bits, so they agree in one of four pieces of these.
    """
    fp, keys = F.col("fp"), []
    for n, pair in enumerate(combinations(BLOCKS, len(BLOCKS) - RADIUS)):
        rest = _packed([b for b in BLOCKS if b not in pair], fp)
        keys.append(F.struct(F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(_packed(pair, fp)).alias("shard"), rest.alias("rest")))
    dealt = common.stored(distinct.select("fp", F.inline(F.array(*keys))), "simhash-shards")
    large = dealt.groupBy("shard").count().where(F.col("count") > MOST).select("shard", F.lit(True).alias("large"))
    if large.isEmpty():
        return dealt.select("fp", "shard")
    pieces = [F.xxhash64("shard", F.lit(k), F.shiftrightunsigned("rest", 10 * k).bitwiseAND(F.lit(1023).cast("long"))) for k in range(RADIUS + 1)]
    split = dealt.join(large, "shard", "left").select("fp", F.explode(F.when(F.col("large"), F.array(*pieces)).otherwise(F.array("shard"))).alias("shard"))
    return common.stored(split, "simhash-shards")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that join what all links among the distinct fingerprints (fp) join."""
    dealt = shards(distinct)
    large = dealt.groupBy("shard").count().where(F.col("count") > MOST).select("shard", F.ceil(F.col("count") / (MOST // 2)).cast("int").alias("trees"))
    # A shard of ordinary size is one cell; of one that is still large each pair of trees is a cell.
    own = F.pmod(F.xxhash64("fp"), F.col("trees").cast("long")).cast("int")
    cells = dealt.join(large, "shard", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("trees") - 1, F.lit(0)))))
    cells = cells.select("shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fp")
    cells = cells.repartition(F.xxhash64("shard", "low", "high")).sortWithinPartitions("shard", "low", "high", "own", "fp")

    def run(batches):
        def solve(rows: np.ndarray) -> list[tuple[int, int]]:
            """Rows of one cell: low, high, own, fp."""
            first = [x & 0xFFFFFFFFFFFFFFFF for x in rows["fp"][rows["own"] == rows["low"][0]].tolist()]
            second = [x & 0xFFFFFFFFFFFFFFFF for x in rows["fp"][rows["own"] != rows["low"][0]].tolist()]
            return forest(first, second, RADIUS)

        kept = None
        for batch in _with_end(batches):
            if batch is not None:
                rows = np.empty(batch.num_rows, np.dtype([("shard", "<i8"), ("low", "<i4"), ("high", "<i4"), ("own", "<i4"), ("fp", "<i8")]))
                for name in rows.dtype.names:
                    rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
                rows = rows if kept is None else np.concatenate([kept, rows])
            else:
                rows = kept
            if rows is None or not len(rows):
                continue
            change = np.flatnonzero((rows["shard"][1:] != rows["shard"][:-1]) | (rows["low"][1:] != rows["low"][:-1]) | (rows["high"][1:] != rows["high"][:-1])) + 1
            bounds = np.concatenate([[0], change, [len(rows)]])
            whole = len(bounds) - 1 if batch is None else len(bounds) - 2
            edges = []
            for i in np.flatnonzero(np.diff(bounds)[:whole] > 1).tolist():
                edges += solve(rows[bounds[i] : bounds[i + 1]])
            kept = rows[bounds[whole] :]
            if edges:
                got = np.array(edges, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return cells.mapInArrow(common.tidy(run), "a long, b long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes that have an edge and aren't that smallest node.

    Goes on until a round changes nothing, which takes about the square of the logarithm of the longest path's length.
    """
    now = common.stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        # Large star: each node's larger neighbours go to the smallest of its neighbours and itself.
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node's smaller neighbours and itself go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, now = now, common.stored(small, "links")
        common.discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, fp and component_id, the smallest doc_id reachable over links."""
    prints = common.stored(fingerprints(docs), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes.select("fp")))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = common.stored(rooted, "simhash-classes")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def bands(h: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes; two sets agree in a key of the same place with probability J ** BAND."""
    least = np.full(BANDS * BAND, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(h), 1 << 12):
        np.minimum(least, (h[lo : lo + (1 << 12), None] * FACTORS + TERMS).min(0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * FACTORS[0]
    for part in least.reshape(BANDS, BAND).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, row, th, fp, bands) of every row of docs (doc_id, row, th, text)."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x.as_py() for x in batch.column(3)]
            fps = np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)
            keys = np.concatenate([bands(np.unique(shingles(x, SHINGLE))) for x in texts] or [np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps), lists], names=["doc_id", "row", "th", "fp", "bands"])

        return work

    return common.map_batches(docs, ["doc_id", "row", "th", "text"], make, "doc_id long, row long, th long, fp long, bands array<long>")


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) among the texts th of classes (th, fp, bands) that join all texts that share a band or are linked by fingerprints."""
    keyed = classes.select("th", F.explode("bands").alias("key"))
    shared = common.stored(keyed.groupBy("key").agg(F.min("th").alias("b"), F.count("*").alias("c")).where("c > 1").select("key", "b"), "near-bands")
    by_band = keyed.join(shared, "key").select(F.col("th").alias("a"), "b")
    prints = common.stored(classes.groupBy("fp").agg(F.min("th").alias("b")), "near-prints")
    by_print = classes.join(prints, "fp").select(F.col("th").alias("a"), "b")
    a, b = (prints.select(F.col("fp").alias(k), F.col("b").alias(f"th_{k}")) for k in "ab")
    by_link = links(prints.select("fp")).join(a, "a").join(b, "b").select("th_a", "th_b")
    return by_band.union(by_print).union(by_link).where("a <> b").distinct()


def joined(sets: list[np.ndarray], own: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs that join what all pairs with a Jaccard similarity of at least `least` join: of all sets, or, if own holds two trees, across them."""
    sizes = np.array([len(x) for x in sets])
    starts, parent, edges = np.concatenate([[0], np.cumsum(sizes)]), list(range(len(sets))), []
    names = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(names.max() + 1, np.int64)
    split = int((own == own[0]).sum())

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(split if split < len(sets) else 1, len(sets)):
        mine, n = names[starts[i] : starts[i + 1]], split if split < len(sets) else i
        mark[mine] = 1
        both = np.add.reduceat(mark[names[: starts[n]]], starts[:n])
        mark[mine] = 0
        for j in np.flatnonzero(both >= least * (sizes[:n] + sizes[i] - both) - 1e-9).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                edges.append((i, j))
    return edges


def similar(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Edges (a, b) that join what all pairs of similar texts (th, text) with the same root join, by exact Jaccard similarity."""
    large = texts.groupBy("root").count().where(F.col("count") > MOST).select("root", F.ceil(F.col("count") / (MOST // 2)).cast("int").alias("trees"))
    own = F.pmod(F.xxhash64("th"), F.col("trees").cast("long")).cast("int")
    cells = texts.join(large, "root", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("trees") - 1, F.lit(0)))))
    cells = cells.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "th", "text")
    cells = cells.repartition(F.xxhash64("root", "low", "high")).sortWithinPartitions("root", "low", "high", "own", "th")

    def run(batches):
        cell, ths, sets, owns = None, [], [], []
        for batch in _with_end(batches):
            edges = []
            rows = [(None,) * 6] if batch is None else zip(*(batch.column(c).to_pylist() for c in ("root", "low", "high", "own", "th", "text")), strict=True)
            for *at, tree, th, text in rows:
                if at != cell:
                    if len(sets) > 1:
                        edges += [(ths[i], ths[j]) for i, j in joined(sets, np.array(owns), least)]
                    cell, ths, sets, owns = at, [], [], []
                if th is not None:
                    h = np.unique(shingles(text, shingle))
                    ths.append(th)
                    sets.append(h if len(h) else np.zeros(1, np.uint64))
                    owns.append(tree)
            if edges:
                got = np.array(edges, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return cells.mapInArrow(common.tidy(run), "a long, b long").distinct()


def survivors(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """docs with one row of each component of texts whose word shingles have a Jaccard similarity of at least `least`.

    That of the smallest doc_id (a null one only where no other is); of more rows with that id the one whose text hashes
    least, of equal texts the least by the other columns. An id in several components keeps a row of each.
    """
    row = F.xxhash64("doc_id", F.isnull("doc_id"), "text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    rows = common.stored(sketches(own), "near-sketches")
    classes = common.stored(rows.groupBy("th").agg(_first_row(), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-classes")
    found = components(candidates(classes)).withColumnRenamed("node", "th")
    found = found.union(found.select(F.col("root").alias("th"), "root")).distinct()
    # One row brings the text of each candidate, so that copies of a text don't meet in one task.
    asked = common.stored(classes.select("th", "first.row").join(found, "th"), "near-asked")
    texts = common.stored(own.select("row", "text").join(asked, "row").dropDuplicates(["th"]).select("root", "th", "text"), "near-texts")
    found = components(similar(texts, shingle, least)).withColumnRenamed("node", "th")
    return _rows_of(docs, row, classes.join(found, "th", "left").select("first", F.coalesce("root", "th").alias("root")))


def _first_row() -> F.Column:
    return F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row")).alias("first")


def _rows_of(docs: DataFrame, row: F.Column, rooted: DataFrame) -> DataFrame:
    """The rows of docs that stand first under their root in rooted (root, first)."""
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_folioscope_row"))
    # The texts move once: the join and the choice among equal rows share one exchange by the row's hash.
    out = docs.withColumn("_folioscope_row", row).join(common.stored(kept, "simhash-kept"), "_folioscope_row")
    others = [F.col(f.name) for f in docs.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    first = F.row_number().over(Window.partitionBy("_folioscope_row").orderBy(*others))
    return out.withColumn("_folioscope_n", first).where("_folioscope_n = 1").select(*docs.columns)
