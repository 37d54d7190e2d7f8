"""Mixing sources to target weights by soft membership, with DataFrame operations alone.

A classifier fitted on labelled rows (naive Bayes over hashed words) gives every document a posterior over domains;
its evidence counts as that of EVIDENCE average words, so memberships stay soft. Document rates r >= least (0, or 1
where no document may go) are those nearest to 1, in squares weighed by tokens, that meet the targets: the rate is
max(least, 1 + sum_k a_k p_dk), and the K numbers a are fitted by Newton steps, shortened or replaced by safe ones where they overshoot. Each step is one aggregation
of K sums and their K * K derivatives over a written table of (tokens, posteriors); only those numbers reach the driver.

The goal is target weight times a total: by default the least total at which no domain shrinks, so every document is
kept and scarce domains repeat. At a least rate of 1 the default holds the shares alone, since soft documents that
repeat add to every domain. Rates are fitted for expected totals, to 1e-5 of the whole; a miss (targets that no rates
meet) gives a warning. copies() rounds them by a hash of the row.

A domain with a share s of the tokens and a target w repeats about w / s times: nothing bounds that, as targets are to be
met, but a rate above FREQUENT gives a warning that names it.

At most `most` labelled rows (those with the least hashes, ties by doc_id) are used for fitting, a documented bound. Rows
with a null text have no tokens and get rate 1; a null or unknown domain isn't learnt from; repeated rows count each, with
the same rate and the same number of copies; very long texts count whole; an empty table gives no rows; other columns are
kept.
"""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import common

BUCKETS = 4096
EVIDENCE = 12
FREQUENT = 100
TARGETS = {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}


def tokens_of(text) -> F.Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \n\t\r]+"), lambda w: w != "")


def bucket(word) -> F.Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS).cast("long")).cast("int")


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], domain: str = "lang", most: int = 8000) -> dict[str, list[float]]:
    """Per domain the logarithm of each bucket's share, from at most `most` labelled rows."""
    chosen = labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.where(F.col(domain).isin(domains)).select("doc_id", F.col(domain).alias("domain"), "text").join(F.broadcast(chosen), "doc_id")
    counts = rows.select("domain", F.explode(tokens_of(F.col("text"))).alias("word")).groupBy("domain", bucket(F.col("word")).alias("bucket")).count().collect()
    out = {}
    for d in domains:
        own = [1.0] * BUCKETS
        for r in counts:
            if r["domain"] == d:
                own[r["bucket"]] += r["count"]
        total = sum(own)
        out[d] = [round(math.log(x / total), 6) for x in own]
    return out


def _summed(buckets: str, table: F.Column) -> F.Column:
    return F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(table, b))


def posteriors(docs: DataFrame, shares: dict[str, list[float]], keep: list[str]) -> DataFrame:
    """The kept columns, tokens, and p_<domain> for each domain."""
    own = docs.select(*keep, F.transform(tokens_of(F.col("text")), bucket).alias("_b"))
    for k, logs in enumerate(shares.values()):
        table = F.from_json(F.lit(json.dumps(logs)), "array<double>")  # folded into one literal
        own = own.withColumn(f"_l{k}", _summed("_b", table) / F.greatest(F.size("_b"), F.lit(1)) * F.least(F.size("_b"), F.lit(EVIDENCE)))
    own = own.select(*keep, F.size("_b").cast("long").alias("tokens"), *[f"_l{k}" for k in range(len(shares))])
    top = F.greatest(*[F.col(f"_l{k}") for k in range(len(shares))]) if len(shares) > 1 else F.col("_l0")
    own = own.select(*keep, "tokens", *[F.exp(F.col(f"_l{k}") - top).alias(f"_e{k}") for k in range(len(shares))])
    total = sum((F.col(f"_e{k}") for k in range(1, len(shares))), F.col("_e0"))
    return own.select(*keep, "tokens", *[(F.col(f"_e{k}") / total).alias(f"p_{d}") for k, d in enumerate(shares)])


def fit_rates(soft: DataFrame, targets: dict[str, float], total: float | None = None, least: float = 0.0, most_steps: int = 60, tolerance: float = 1e-5) -> F.Column:
    """The rate of a row as an expression over tokens and p_<domain>; soft should be a written table. Warns of targets that aren't met."""
    p, n = [F.col(f"p_{d}") for d in targets], len(targets)
    weight = F.col("tokens").cast("double")
    share = sum(targets.values())
    want = np.array([w / share for w in targets.values()])
    base = np.array([float(x or 0.0) for x in soft.agg(*[F.sum(weight * q) for q in p]).first()])
    # With every rate at least 1 no domain shrinks whatever the total is, so only the shares are held.
    free = total is None and least >= 1
    total = total or max([t / w for t, w in zip(base, want, strict=True) if w > 0 and t > 0], default=0.0)
    goal = np.zeros(n) if free else total * want
    q = [x - F.lit(float(w)) for x, w in zip(p, want, strict=True)] if free else p
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def rate_of(at: np.ndarray):
        raw = sum((x * F.lit(float(a)) for x, a in zip(q[1:], at[1:], strict=True)), F.lit(1.0) + q[0] * F.lit(float(at[0])))
        return raw, F.greatest(F.lit(float(least)), raw)

    def look(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float, float]:
        """The dual function, its slope, its curvature, the largest miss as a share of the tokens, and the largest rate."""
        raw, rate = rate_of(at)
        free_row = raw >= F.lit(float(least))
        value = F.sum(weight * F.when(free_row, raw * raw / 2).otherwise(raw * least - least * least / 2))
        sums = [F.sum(weight * rate * x) for x in q] + [F.sum(F.when(free_row, weight * q[i] * q[j]).otherwise(0.0)) for i, j in pairs]
        got = [float(x or 0.0) for x in soft.agg(value, F.sum(weight * rate), F.max(rate), *sums).first()]
        slope, curve = np.array(got[3 : n + 3]) - goal, np.zeros((n, n))
        for (i, j), x in zip(pairs, got[n + 3 :], strict=True):
            curve[i, j] = curve[j, i] = x
        return got[0] - float(goal @ at), slope, curve, float(abs(slope).max()) / max(1.0, got[1] if free else total), got[2]

    at = np.zeros(n)
    value, slope, curve, miss, most_often = look(at)
    steps, ridge = 1, 1e-9 * max(1.0, float(base.sum()))
    whole = curve + ridge * np.eye(n)  # at rates of 1 every row counts: no curvature is above this one, so its step is safe
    while miss > tolerance and steps < most_steps:
        move = -np.linalg.solve(curve + ridge * np.eye(n), slope)
        for ahead in [move, move / 2, move / 4, move / 8, -np.linalg.solve(whole, slope)]:
            tried, steps = look(at + ahead), steps + 1
            if tried[0] <= value + 1e-4 * float(slope @ ahead) or tried[3] <= tolerance:
                break
        at, (value, slope, curve, miss, most_often) = at + ahead, tried
    if miss > tolerance:
        warnings.warn(f"mixing: a domain misses its target by {miss:.6f} of the tokens after {steps} steps", stacklevel=2)
    if most_often > FREQUENT:
        warnings.warn(f"mixing: documents of a scarce domain repeat up to {most_often:.0f} times", stacklevel=2)
    return F.when(F.col("tokens") > 0, rate_of(at)[1]).otherwise(1.0)


def copies(rate, *keys: str) -> F.Column:
    """The rate rounded to a whole number by a hash of the row's keys, so that its mean is kept."""
    draw = F.pmod(F.xxhash64(*keys, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = "lang", total: float | None = None) -> DataFrame:
    """Per row of docs: doc_id, th (hash of the text), tokens, posteriors, rate and copies."""
    targets = targets or TARGETS
    shares = fit_classifier(docs, labels, list(targets), domain)
    soft = common.stored(posteriors(docs.withColumn("th", F.xxhash64("text")), shares, ["doc_id", "th"]), "mixing")
    rate = F.round(fit_rates(soft, targets, total), 9)
    return soft.withColumn("rate", rate).withColumn("copies", copies(F.col("rate"), "doc_id", "th"))


def apply(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = "lang", total: float | None = None, least: float = 1.0) -> DataFrame:
    """Each row of docs as often as its copies say; the columns of docs. At a least rate of 1 no row goes."""
    targets = targets or TARGETS
    shares = fit_classifier(docs, labels, list(targets), domain)
    own = docs.select(*[F.col(c).alias(f"own_{k}") for k, c in enumerate(docs.columns)], "text", "doc_id")
    soft = common.stored(posteriors(own, shares, own.columns[:-2] + ["doc_id"]).withColumn("th", F.xxhash64(f"own_{docs.columns.index('text')}")), "mixing-texts")
    rate = F.round(fit_rates(soft, targets, total, least), 9)
    repeated = soft.withColumn("copies", copies(rate, "doc_id", "th")).where("copies > 0")
    return repeated.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(docs.columns)])
