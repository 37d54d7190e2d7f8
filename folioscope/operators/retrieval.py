"""Filters, exact vector search, BM25 over postings, and rank fusion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.schema import Scope

K1, B, LONGEST_TOKEN, RRF_K = 1.2, 0.75, 30, 60


# ---- predicates ----


def has_all_tags(tags: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), tags)) == 0 if wanted else F.lit(True)


def under_path(path: Column, prefix: str | None, like: bool = False) -> Column:
    """A prefix; with like, % and _ in it are wild."""
    if not prefix:
        return F.lit(True)
    return path.like(prefix.replace("\\", "\\\\") + "%") if like else path.startswith(prefix)


def scoped(chunks: DataFrame, tags: Sequence[str] = (), path: str | None = None, like: bool = False) -> DataFrame:
    """Chunks that hold all tags and lie under the path."""
    out = chunks.where(under_path(F.col("source_path"), path, like)) if path else chunks
    return out.where(has_all_tags(F.col("tags"), tags)) if tags else out


def min_score(results: DataFrame, least: float) -> DataFrame:
    """Rows that score enough; those without a score pass."""
    return results.where(F.coalesce(F.col("relevance_score"), F.lit(1.0)) >= least)


def first_of_each(results: DataFrame, key: str = "id", order: str = "hit_rank") -> DataFrame:
    """The first row of each id."""
    by = Window.partitionBy(key).orderBy(order)
    return results.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def with_ids(chunks: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Chunks of a table of ids; those that are missing are left out."""
    return chunks.join(ids.select(id_col), id_col, "left_semi")


def sources_named(chunks: DataFrame, name: str, name_col: str = "wikilink_name", path_col: str = "source_path") -> DataFrame:
    """The distinct paths of the notes with a name."""
    return chunks.where(F.col(name_col) == name).select(path_col).distinct()


# ---- vectors ----


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column, epsilon: float = 1e-10) -> Column:
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return total(a, b) / ((F.sqrt(total(a, a)) + epsilon) * (F.sqrt(total(b, b)) + epsilon))


def knn(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "id", vector_col: str = "embeddings", metric: str = "l2") -> DataFrame:
    """The k nearest rows of one query vector: (id, distance or score, rank from 1)."""
    q = F.lit([float(x) for x in query])
    if metric == "l2":
        ordered = vectors.select(id_col, l2(F.col(vector_col), q).alias("distance")).orderBy("distance", id_col)
    else:
        ordered = vectors.select(id_col, cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), id_col)
    return ranked(ordered.limit(k), "distance" if metric == "l2" else "score", id_col, metric != "l2")


def ranked(few: DataFrame, by: str, id_col: str = "id", descending: bool = False, name: str = "rank") -> DataFrame:
    """Ranks from 1 for a result of bounded size (after a limit)."""
    order = F.desc(by) if descending else F.asc(by)
    return few.withColumn(name, F.row_number().over(Window.orderBy(order, F.col(id_col))))


# ---- full text ----


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of at most 30 characters."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t) <= LONGEST_TOKEN)


def postings(chunks: DataFrame, column: str, id_col: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """(kept columns, term, id, length, tf): the inverted index of one column, to be written once and read by term."""
    own = chunks.select(*keep, id_col, tokens(F.col(column)).alias("t"))
    return own.select(*keep, id_col, F.size("t").alias("length"), F.explode("t").alias("term")).groupBy(*keep, "term", id_col, "length").agg(F.count("*").alias("tf"))


def term_statistics(chunks: DataFrame, column: str) -> DataFrame:
    """(term, document frequency, collection frequency), with one exchange of partial sums.

    A row's tokens are sorted, so each term's first one in the row is known before anything is exchanged.
    """
    own = chunks.select(F.sort_array(tokens(F.col(column))).alias("t"))
    marked = F.transform("t", lambda x, i: F.struct(x.alias("term"), F.when((i > 0) & (F.get("t", i - 1) == x), 0).otherwise(1).alias("first")))
    return own.select(F.inline(marked)).groupBy("term").agg(F.sum("first").alias("df"), F.count("*").alias("cf"))


def query_terms(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("t")).first()["t"]


def weighed(hits: DataFrame, sizes: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, score) of hits (term, id, length, tf), given the one row of sizes (n rows, mean length)."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.join(F.broadcast(df), "term").join(F.broadcast(sizes.withColumn("one", F.lit(1))), F.lit(1) == F.col("one")).select(id_col, weight.alias("score"))


def summed(parts: Sequence[DataFrame], id_col: str = "id") -> DataFrame:
    """Scores of several columns added up, rounded so that equal ones stay equal whatever the order of the sum."""
    return reduce(DataFrame.union, parts).groupBy(id_col).agg(F.round(F.sum("score"), 9).alias("score"))


def best(scores: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The k best rows: (id, score, rank from 1)."""
    return ranked(scores.orderBy(F.desc("score"), id_col).limit(k), "score", id_col, True)


def bm25(chunks: DataFrame, query: str, columns: Sequence[str] = ("content",), id_col: str = "id", terms: Sequence[str] | None = None) -> DataFrame:
    """(id, score) of the rows that hold a query term, summed over the columns; for tables without postings.

    Each row's counts of the query's terms are worked out in place. One scan adds up all that the weights need (rows,
    tokens and document frequencies: one row), another scores the rows, and nothing else is exchanged.
    """
    terms = query_terms(chunks.sparkSession, query) if terms is None else list(terms)
    if not terms:
        return chunks.select(id_col, F.lit(0.0).alias("score")).limit(0)
    is_word = lambda w: lambda t: t == w
    wanted, found = F.array(*[F.lit(t) for t in terms]), []
    own = chunks
    for c in columns:
        own = own.withColumn(f"_t_{c}", tokens(F.col(c)))
    counted = [F.struct(F.size(f"_t_{c}").alias("length"), F.filter(f"_t_{c}", lambda t: F.array_contains(wanted, t)).alias("hits")).alias(f"_{c}") for c in columns]
    own = own.select(id_col, *counted)
    tf = [[F.size(F.filter(F.col(f"_{c}.hits"), is_word(w))).alias(f"_{k}_{j}") for j, w in enumerate(terms)] for k, c in enumerate(columns)]
    own = own.select(id_col, *[F.col(f"_{c}.length").alias(f"_length_{k}") for k, c in enumerate(columns)], *[x for row in tf for x in row])
    pairs = [(k, j) for k in range(len(columns)) for j in range(len(terms))]
    sums = own.agg(F.count("*").alias("_n"), *[F.avg(f"_length_{k}").alias(f"_mean_{k}") for k in range(len(columns))], *[F.count_if(F.col(f"_{k}_{j}") > 0).alias(f"_df_{k}_{j}") for k, j in pairs])
    for k, j in pairs:
        n, df, count = F.col("_n"), F.col(f"_df_{k}_{j}"), F.col(f"_{k}_{j}")
        weight = F.log(1.0 + (n - df + 0.5) / (df + 0.5)) * count * (K1 + 1) / (count + K1 * (1 - B + B * F.col(f"_length_{k}") / F.col(f"_mean_{k}")))
        found.append(F.when(count > 0, weight).otherwise(0.0))
    hit = reduce(lambda a, b: a | b, [F.col(f"_{k}_{j}") > 0 for k, j in pairs])
    rows = own.where(hit).join(F.broadcast(sums.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"))
    return summed([rows.select(id_col, reduce(lambda a, b: a + b, found).alias("score"))], id_col)


def full_text(chunks: DataFrame, query: str, k: int, scope: Scope = Scope.CONTENT, id_col: str = "id") -> DataFrame:
    """The k best rows: (id, score, rank from 1)."""
    return best(bm25(chunks, query, scope.value, id_col), k, id_col)


# ---- fusion ----


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int, id_col: str = "id", constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: (id, vector_rank, text_rank, fused, rank)."""
    a = vector_hits.select(id_col, F.col("rank").alias("vector_rank"))
    b = text_hits.select(id_col, F.col("rank").alias("text_rank"))
    share = lambda r: F.coalesce(F.lit(1.0) / (F.lit(float(constant)) + F.col(r)), F.lit(0.0))
    both = a.join(b, id_col, "full_outer").withColumn("fused", share("vector_rank") + share("text_rank"))
    return ranked(both.orderBy(F.desc("fused"), id_col).limit(k), "fused", id_col, True)


def hybrid(chunks: DataFrame, query: str, vector: Sequence[float], limit: int = 5, tags: Sequence[str] = (), path: str | None = None, scope: Scope = Scope.ALL, id_col: str = "id", like: bool = False) -> DataFrame:
    """Filter, search both ways, fuse, limit."""
    own = scoped(chunks, tags, path, like)
    return fuse(knn(own.where(F.col("embeddings").isNotNull()), vector, limit, id_col), full_text(own, query, limit, scope, id_col), limit, id_col)
