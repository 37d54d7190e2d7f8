"""Line dedup by winnowing, with DataFrame operations alone.

A text is cut into units: lines, and within lines sentences. The gram at a unit is the shortest run from there with
min_words words (or most_units units), so equal passages have equal grams wherever they stand. Winnowing keeps a gram
if it is the least of some window of `window` neighbours, and always keeps one made of a single long unit: a repeated
passage of at least `window` grams shares a kept gram with its first occurrence for sure, which holds for every passage
of 50 words and more with the defaults.

The kept grams' hashes are joined to their first occurrence (least doc_id, then text hash, then place): one link for
each later occurrence, never pairs. Links on one alignment of two texts are merged into islands, islands of a text that
touch into stretches; the first, the last and the longest island of a stretch are extended both ways, unit by unit, as
long as both texts agree, and the stretch is deleted from the later text. At an end of a stretch less than `window`
grams can stay, where the grams there first occurred in other texts than the rest.

An extension looks at most_units + window units each way, which is as far as any can lead: if the last most_units units of
a run hold a word, the gram that begins with them is one of `window` neighbours that lie in the run whole, so both texts
keep one of these, and it ends less than most_units + window units before the run does. If they hold none, they are blank.

Rows with the same doc_id and text are one document: they lose the same units. Null ids come first in the order. Null
texts stay null, texts that lose all units become empty (or go, if so asked), empty tables give no rows, and other
columns are kept; a column n_chars is counted anew. Nothing shorter than a gram is ever deleted: a run of min_words words,
or of most_units units with a word where lines are short. Ties between equal grams go to the least place of the order;
very long texts are one row, and all their units are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import common

CUT = r"(?<=\n)|(?<=[.!?] )"
MIN_WORDS = 16
MOST_UNITS = 6
WINDOW = 3
NO_GRAM = (1 << 63) - 1


def units(text) -> F.Column:
    return F.split(text, CUT)


def _at(array, i):
    return F.get(array, i)


def gram_table(docs: DataFrame, min_words: int = MIN_WORDS, most_units: int = MOST_UNITS) -> DataFrame:
    """Per distinct (doc_id, text): key columns id and th, unit hashes h, and grams g as (hash, number of units)."""
    trimmed = lambda u: F.btrim(u, F.lit(" \t\r\n"))
    own = docs.where(F.col("text").isNotNull() & (F.col("text") != "")).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.transform(units(F.col("text")), trimmed).alias("u"))
    own = own.select("id", "th", F.transform("u", lambda u: F.xxhash64(u)).alias("h"), F.transform("u", lambda u: F.when(u == "", 0).otherwise(F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit(""))) + 1)).alias("w"))

    def gram(h, i):
        count, words = F.lit(None).cast("int"), F.coalesce(_at("w", i), F.lit(0))
        sums = [words]
        for k in range(1, most_units):
            sums.append(sums[-1] + F.coalesce(_at("w", i + k), F.lit(0)))
        for k in reversed(range(most_units)):
            count = F.when(sums[k] >= min_words, k + 1).otherwise(count if k < most_units - 1 else F.when((i + most_units <= F.size("h")) & (sums[k] > 0), most_units))
        return count

    own = own.withColumn("n", F.transform("h", gram))
    hashed = F.transform("n", lambda n, i: F.when(n.isNull(), F.lit(NO_GRAM)).when(n == 1, _at("h", i)).otherwise(F.xxhash64(F.slice("h", i + 1, n))))
    return own.select("id", "th", "h", "n", "w", hashed.alias("g"))


def occurrences(grams: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, place, n, g) of the grams that winnowing keeps."""

    def kept(g, i):
        value = lambda k: F.coalesce(F.when(i + k >= 0, _at("g", F.greatest(i + k, F.lit(0)))), F.lit(NO_GRAM))
        least = [g <= value(k) for k in range(1 - window, window)]
        windows = None
        for first in range(1 - window, 1):
            one = None
            for k in range(first, first + window):
                one = least[k + window - 1] if one is None else one & least[k + window - 1]
            windows = one if windows is None else windows | one
        return (g != NO_GRAM) & ((_at("w", i) >= min_words) | windows)

    marked = F.filter(F.transform("g", lambda g, i: F.when(kept(g, i), F.struct(i.alias("place"), _at("n", i).alias("n"), g.alias("g")))), lambda x: x.isNotNull())
    return grams.select("id", "th", F.explode(marked).alias("x")).select("id", "th", "x.place", "x.n", "x.g")


def runs(docs: DataFrame, min_words: int = MIN_WORDS, most_units: int = MOST_UNITS, window: int = WINDOW) -> DataFrame:
    """(id, th, start, stop, src_id, src_th, shift): later repeated runs of units, and a text that they come from."""
    grams = common.stored(gram_table(docs, min_words, most_units).dropDuplicates(["id", "th"]), "lines")
    places = occurrences(grams, window, min_words)
    first = F.min(F.struct("id", "th", "place"))
    # Written first, so that both sides of the join are exchanges: Spark can then split the rows of a hot gram.
    repeated = common.stored(places.groupBy("g").agg(first.alias("first"), F.count("*").alias("c")).where("c > 1").select("g", "first"), "line-grams")
    links = places.join(repeated, "g").where(~F.struct("id", "th", "place").eqNullSafe(F.col("first")))
    links = links.select("id", "th", "place", "n", F.col("first.id").alias("src_id"), F.col("first.th").alias("src_th"), (F.col("place") - F.col("first.place")).alias("shift"))
    links = common.stored(links, "line-links").repartition("id", "th")

    line = ["id", "th", "src_id", "src_th", "shift"]
    ahead = Window.unboundedPreceding, -1
    by = Window.partitionBy(*line).orderBy("place", "n")
    fresh = F.col("place") > F.max(F.col("place") + F.col("n")).over(by.rowsBetween(*ahead))
    islands = links.withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(by)).groupBy(*line, "run").agg(F.min("place").alias("start"), F.max(F.col("place") + F.col("n")).alias("stop")).drop("run")
    # Islands of a text that touch, whatever their sources, make one stretch; it grows by its first, last and longest island.
    by = Window.partitionBy("id", "th").orderBy("start", "stop", "src_id", "src_th", "shift")
    fresh = F.col("start") > F.max("stop").over(by.rowsBetween(*ahead))
    link = F.struct("src_id", "src_th", "shift", "start", "stop")
    order = [F.col(c) for c in line[2:]]
    stretches = islands.withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(by)).groupBy("id", "th", "run").agg(
        F.min("start").alias("low"), F.max("stop").alias("high"), F.min_by(link, F.struct("start", -F.col("stop"), *order)).alias("first"),
        F.max_by(link, F.struct("stop", -F.col("start"), *order)).alias("last"), F.max_by(link, F.struct(F.col("stop") - F.col("start"), *order)).alias("longest"),
    )

    reach = most_units + window
    around = lambda a, b: (
        F.reverse(F.slice("h", F.greatest(a - reach, F.lit(0)) + 1, F.least(a, F.lit(reach)))),
        F.slice("h", b + 1, F.lit(reach)),
    )
    own = grams.select("id", "th", "h")
    ends = _join(stretches, own, ["id", "th"]).select("id", "th", "low", "high", "h", F.explode(F.array_distinct(F.array("first", "last", "longest"))).alias("link")).select("id", "th", "low", "high", "h", "link.*")
    left, right = around(F.col("start"), F.col("stop"))
    ends = ends.select("id", "th", "low", "high", "src_id", "src_th", "shift", "start", "stop", left.alias("left"), right.alias("right"))
    both = _join(ends, own.select(F.col("id").alias("src_id"), F.col("th").alias("src_th"), "h"), ["src_id", "src_th"])
    src_left, src_right = around(F.col("start") - F.col("shift"), F.col("stop") - F.col("shift"))
    both = both.select("id", "th", "low", "high", "src_id", "src_th", "shift", "start", "stop", "left", "right", src_left.alias("src_left"), src_right.alias("src_right"))
    start, stop = F.col("start") - _agreeing(F.col("left"), F.col("src_left")), F.col("stop") + _agreeing(F.col("right"), F.col("src_right"))
    # A deleted unit's copy stands earlier in the order, so the first copy of every unit stays, in one text too.
    return both.select("id", "th", F.least(start, "low").alias("start"), F.greatest(stop, "high").alias("stop"), "src_id", "src_th", "shift")


def _agreeing(a: F.Column, b: F.Column) -> F.Column:
    """How many units two arrays share from their starts on."""

    def step(s, x):
        on = s["on"] & F.coalesce(x["a"] == x["b"], F.lit(False))
        return F.struct((s["n"] + F.when(on, 1).otherwise(0)).alias("n"), on.alias("on"))

    return F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), step)["n"]


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join that matches null keys too."""
    b = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    test = None
    for k in keys:
        one = a[k].eqNullSafe(b[f"_{k}"])
        test = one if test is None else test & one
    return a.join(b, test, how).drop(*[f"_{k}" for k in keys])


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, most_units: int = MOST_UNITS, window: int = WINDOW, drop_emptied: bool = False) -> DataFrame:
    """docs with later repeated runs deleted from text; the columns of docs. drop_emptied leaves out texts that lost all."""
    cut = runs(docs, min_words, most_units, window).groupBy("id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("_folioscope_cut"))
    cut = common.stored(cut, "line-cuts").select(F.col("id").alias("_folioscope_id"), F.col("th").alias("_folioscope_th"), "_folioscope_cut")
    joined = docs.join(cut, docs["doc_id"].eqNullSafe(cut["_folioscope_id"]) & (F.xxhash64(docs["text"]) == cut["_folioscope_th"]), "left")
    kept = F.filter(units(F.col("text")), lambda u, i: ~F.exists("_folioscope_cut", lambda c: (i >= c["start"]) & (i < c["stop"])))
    text = F.when(F.col("_folioscope_cut").isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    joined = joined.withColumn("text", text)
    if drop_emptied:
        joined = joined.where(F.col("_folioscope_cut").isNull() | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)
