"""Licence scans, line dedup, mixing and the pipeline against brute force."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.llm import licences, lines, mixing, registry

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, start)], DOC)


def test_licences_equal_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(licences.oracle_sql()).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in registry.op7_licences(spark, small).collect()}
    assert got == want


def test_licences_by_hand(spark):
    texts = [
        "The MIT License, an mit license; Apache LICENSE", None, "", "---", "mit", "general public general public license", "mit licenseé", "x" * 100_000 + " mit license",
        "Permission is hereby granted, free of charge, to any person kindly obtaining a copy of this software and associated documentation files",
    ]
    rows = {r["doc_id"]: r for r in licences.scan(frame(spark, texts)).collect()}
    assert (rows[0]["n_words"], rows[0]["n_base"], rows[0]["first_word"], rows[0]["last_word"], rows[0]["base_labels"]) == (8, 3, 1, 6, "apache,mit")
    assert [rows[i]["n_words"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert rows[5]["base_labels"] == "gpl"
    assert rows[5]["first_word"] == 2
    assert rows[6]["n_base"] == 0
    assert rows[7]["n_base"] == 1
    assert rows[8]["labels"] == "mit-grant"
    assert 0.8 <= rows[8]["score"] < 1
    assert licences.scan(frame(spark, ["a"]).limit(0)).count() == 0
    twice = frame(spark, ["mit license"]).union(frame(spark, ["mit license"])).withColumn("w", F.lit(1)).withColumn("row", F.lit(2))
    assert [r["n_base"] for r in licences.scan(twice).collect()] == [1, 1]


def words(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def sentences(rng, n):
    return " ".join(words(rng, rng.randrange(2, 14)).capitalize() + "." for _ in range(n))


def test_line_dedup_deletes_later_passages(spark):
    rng = random.Random(4)
    passages = [sentences(rng, 9), "Long " + words(rng, 60) + ".", "\n".join(sentences(rng, 1) for _ in range(12))]
    texts = [sentences(rng, 6) for _ in range(40)]
    for k in range(30):
        p = passages[k % 3]
        texts.append(f"{sentences(rng, 3)}\n{p}\n{sentences(rng, 4)}" if k % 2 else f"{sentences(rng, 2)} {p} {sentences(rng, 2)}")
    docs = frame(spark, texts)
    got = [r["text"] for r in lines.dedup(docs).orderBy("doc_id").collect()]
    assert got[:43] == texts[:43]  # clean texts and the first of each passage
    for k in range(3, 30):
        assert got[40 + k] != texts[40 + k]
        own = passages[k % 3].split()
        for i in range(len(own) - 30):
            assert " ".join(own[i : i + 30]) not in " ".join(got[40 + k].split())
        for line in (texts[40 + k].split("\n")[0], texts[40 + k].split("\n")[-1]):
            assert k % 2 == 0 or line in got[40 + k]


def brute(texts, min_words=16):
    """50-word windows that occur in an earlier text."""
    seen, left = set(), 0
    for t in texts:
        w = (t or "").split()
        own = {" ".join(w[i : i + 50]) for i in range(len(w) - 49)}
        left += len(own & seen)
        seen |= own
    return left


def test_line_dedup_edges(spark):
    rng = random.Random(5)
    a, hot = sentences(rng, 20), sentences(rng, 8)
    texts = [a, a, None, "", "short.", "short.", "\n\n", hot + " " + hot, *[hot + f"\nown {k}." for k in range(30)], "Is it. " * 300]
    docs = frame(spark, texts)
    out = lines.dedup(docs).orderBy("doc_id").collect()
    got = [r["text"] for r in out]
    assert got[:7] == [a, "", None, "", "short.", "short.", "\n\n"]
    assert got[7].split() == hot.split()
    assert all(got[8 + k].strip() == f"own {k}." for k in range(30))
    assert 0 < len(got[-1]) < 200
    assert brute(got) == 0
    assert [r["n_chars"] for r in out if r["text"] is not None] == [len(t) for t in got if t is not None]
    assert lines.dedup(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in lines.dedup(docs, drop_emptied=True).collect()) == [i for i in range(len(texts)) if i != 1]
    assert lines.dedup(docs).columns == docs.columns
    again = docs.union(docs.where("doc_id = 0")).union(spark.createDataFrame([(None, a, "en", "s", 1)], DOC))
    kept = [(r["doc_id"], r["text"]) for r in lines.dedup(again).where("doc_id is null or doc_id = 0").collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (0, ""), (0, "")], key=str)


def check_units(before, after):
    """What is gone stood in an earlier place, and one of each different unit stays."""
    import re

    cut = re.compile(lines.CUT)
    seen, kept = set(), set()
    for old, new in zip(before, after, strict=True):
        own = [u.strip(" \t\r\n") for u in cut.split(old or "")]
        left = [u.strip(" \t\r\n") for u in cut.split(new or "")]
        k = 0
        for u in own:  # units that stay keep their order
            if k < len(left) and left[k] == u:
                k += 1
            else:
                assert u == "" or u in seen, u
            seen.add(u)
        assert k == len(left) or not any(left[k:])
        kept |= set(left)
    assert {u for u in seen if u} <= kept


def test_line_dedup_deletes_only_copies(spark):
    rng = random.Random(12)
    passages = [sentences(rng, rng.randrange(3, 15)) for _ in range(12)] + ["\n".join(words(rng, rng.randrange(1, 4)) for _ in range(20)) for _ in range(6)]
    passages.append(passages[0] + "\n" * 30 + "tail " + passages[12])  # a run with more blank units than an extension looks at
    texts = []
    for _ in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else sentences(rng, rng.randrange(1, 8)) for _ in range(rng.randrange(1, 6))]
        texts.append(rng.choice([" ", "\n", "\n\n"]).join(parts))
    after = [r["text"] for r in lines.dedup(frame(spark, texts)).orderBy("doc_id").collect()]
    check_units(texts, after)
    assert brute(texts) > 500
    assert brute(after) <= 0.01 * brute(texts)
    short = "one\ntwo\nthree\nfour\nfive\nsix"
    again = [r["text"] for r in lines.dedup(frame(spark, ["a b\n" + short, short, "one\ntwo"])).orderBy("doc_id").collect()]
    assert again == ["a b\n" + short, "", "one\ntwo"]  # six short lines are a gram, two are not


def test_line_dedup_of_a_very_long_text(spark):
    rng = random.Random(13)
    long = " ".join(words(rng, rng.randrange(4, 12)) + "." for _ in range(40_000))
    after = [r["text"] for r in lines.dedup(frame(spark, [long, long[: len(long) // 2] + " Own end here."])).orderBy("doc_id").collect()]
    assert after[0] == long
    assert len(after[1]) < 200


def test_rates_are_the_least_squares_solution(spark):
    """No feasible step from the fitted rates lowers the sum of squares."""
    import numpy as np

    rng = np.random.default_rng(14)
    kinds = ["en", "de", "es", "fr"]
    for least in (0.0, 0.5):
        p = rng.dirichlet([0.4] * 4, 60)
        tokens = rng.integers(1, 300, 60)
        soft = spark.createDataFrame([(int(t), *map(float, row)) for t, row in zip(tokens, p, strict=True)], "tokens long, " + ", ".join(f"p_{k} double" for k in kinds))
        total = float(tokens.sum()) * 1.3
        got = soft.withColumn("rate", mixing.fit_rates(soft, mixing.TARGETS, total=total, least=least)).toPandas()
        p, t, rate = got[[f"p_{k}" for k in kinds]].to_numpy(), got.tokens.to_numpy(), got.rate.to_numpy()
        assert (p.T * t) @ rate == pytest.approx([w * total for w in mixing.TARGETS.values()], rel=1e-3)
        assert rate.min() >= least
        cost = float((t * (rate - 1) ** 2).sum())
        _, _, v = np.linalg.svd(p.T * t)
        null = v[4:]  # directions that keep the domains' totals
        for _ in range(2000):
            step = rng.normal(size=len(null)) @ null
            step *= rng.choice([1e-3, 1e-2, 1e-1, 1.0])
            for sign in (1, -1):
                moved = rate + sign * step
                if moved.min() >= least:
                    assert (t * (moved - 1) ** 2).sum() >= cost - 1e-3 * (1 + abs(step).max())


def test_mixing_repeated_rows_and_long_texts(spark):
    rows = [(1, "the and of " * 50_000, "en", "s", 1), (2, "der und von " * 9, "de", "s", 1), (2, "der und von " * 9, "de", "s", 1), (3, "der", "de", "s", 1), (4, "el y de", "es", "s", 1), (5, "le et du", "fr", "s", 1)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, 1) for i in range(1, 6)], "doc_id long, quality int")
    with pytest.warns(UserWarning, match="repeat up to"):
        got = mixing.mix(docs, labels).toPandas()
    assert got[got.doc_id == 1].tokens.tolist() == [150_000]
    both = got[got.doc_id == 2]
    assert len(both) == 2
    assert both.rate.nunique() == both.copies.nunique() == 1


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    kinds = {"en": "the and of", "de": "der und von", "es": "el y de", "fr": "le et du"}
    rows = []
    for i in range(400):
        lang = "en" if i % 10 < 6 else ("de", "es", "fr", "fr")[i % 4]
        rows.append((i, " ".join(rng.choice(kinds[lang].split() + [f"{lang}{rng.randrange(40)}"]) for _ in range(rng.randrange(5, 80))), lang, "s", 1))
    rows += [(400, None, "en", "s", 0), (401, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 400, 2)], "doc_id long, quality int")
    got = mixing.mix(docs, labels).toPandas()
    assert len(got) == len(rows)
    assert (got.rate >= -1e-9).all()
    sums = {d: (got.tokens * got[f"p_{d}"] * got.rate).sum() for d in mixing.TARGETS}
    for d, w in mixing.TARGETS.items():
        assert sums[d] / sum(sums.values()) == pytest.approx(w, abs=2e-3)
    assert (got[[f"p_{d}" for d in mixing.TARGETS]].sum(axis=1) - 1).abs().max() < 1e-9
    assert got[got.doc_id == 400].rate.tolist() == [1.0]
    shares = mixing.mix(docs, labels, total=float(got.tokens.sum()) / 2).toPandas()
    assert shares.rate.mean() < 1
    assert mixing.mix(docs.limit(0), labels).count() == 0
    repeated = mixing.apply(docs, labels)
    assert repeated.columns == docs.columns
    assert {r["doc_id"] for r in repeated.select("doc_id").distinct().collect()} == set(range(402))


def test_pipeline(spark, small):
    import corpus_pipeline
    from folioscope.llm import common, simhash

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing", "packing"]
    docs = common.table(spark, small, "documents")
    kept = common.stored(corpus_pipeline.keep_quality(spark, docs, small), "t1")
    assert kept.columns == docs.columns
    quality = {r["doc_id"]: r["quality"] for r in common.table(spark, small, "labels").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum(quality[i] == 1 for i in quality if i in ids) >= 0.97 * sum(q == 1 for q in quality.values())
    lined = common.stored(corpus_pipeline.dedup_lines(spark, kept, small), "t2")
    before, after = ([r["text"] for r in x.orderBy("doc_id").collect()] for x in (kept, lined))
    assert brute(after) <= 0.05 * brute(before)
    near = common.stored(corpus_pipeline.dedup_near(spark, lined, small), "t3")
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in near.collect()}
    values = list(prints.values())
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(values) for b in values[:i])
    mixed = common.stored(corpus_pipeline.mix_sources(spark, near, small), "t4")
    assert {r["doc_id"] for r in mixed.collect()} == set(prints)
    packed = corpus_pipeline.pack_sequences(spark, mixed, small)
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    assert corpus_pipeline.run(spark, small).count() > 0


def test_stages_keep_clashing_columns(spark, small):
    import corpus_pipeline
    from folioscope.llm import common

    docs = common.table(spark, small, "documents").limit(60)
    for name in ("score", "th", "tokens", "copies", "fp", "g", "id", "row", "component_id"):
        docs = docs.withColumn(name, F.lit(name))
    docs = common.stored(docs, "clash")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, small), "clash")
        assert docs.where("score = 'score' and th = 'th' and g = 'g'").count() == docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0


def test_survivors_of_repeated_ids(spark):
    from folioscope.llm import simhash

    rows = spark.createDataFrame([(1, "b", "x"), (1, "b", "w"), (1, "completely different words here", "v"), (None, None, "n")], "doc_id long, text string, lang string")
    kept = sorted(((r["doc_id"], r["text"], r["lang"]) for r in simhash.survivors(rows).collect()), key=str)
    assert kept == [(1, "b", "w"), (1, "completely different words here", "v"), (None, None, "n")]
    same = simhash.survivors(rows.where("text = 'b'")).collect()
    assert [(r["doc_id"], r["text"], r["lang"]) for r in same] == [(1, "b", "w")]


def test_survivors_keep_every_component(spark):
    from folioscope.llm import simhash

    rng = random.Random(8)
    texts = [words(rng, 30) for _ in range(40)]
    rows = [(None, t) for t in texts[:20]] + [(7, t) for t in texts[20:30]] + [(i, t) for i, t in enumerate(texts[30:], 100)]
    rows += [(None, texts[30]), (3, texts[20]), (None, texts[0])]
    got = simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in got) == sorted(texts)
    ids = {r["text"]: r["doc_id"] for r in got}
    assert (ids[texts[0]], ids[texts[20]], ids[texts[21]], ids[texts[30]]) == (None, 3, 7, 100)


def test_survivors_equal_brute_force_jaccard(spark):
    from folioscope.llm import simhash

    rng = random.Random(9)
    texts = []
    for k in range(60):
        own = words(rng, rng.randrange(40, 400)).split()
        texts.append(" ".join(own))
        for _ in range(k % 4):
            near = list(own)
            for _ in range(max(1, len(own) * (k % 5) // 150)):
                near[rng.randrange(len(near))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(near))
    texts += [None, "", " ", "one", "One", "two words"]

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                linked += 1
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert linked > 50
    docs = frame(spark, texts)
    got = sorted(r["doc_id"] for r in simhash.survivors(docs).collect())
    assert got == sorted(set(root)) != sorted(range(len(texts)))
    old = simhash.MOST
    try:
        simhash.MOST = 2  # components as pairs of trees
        assert sorted(r["doc_id"] for r in simhash.survivors(docs).collect()) == got
    finally:
        simhash.MOST = old


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_rates_of_a_skewed_corpus_meet_targets(spark, least):
    rng, kinds = random.Random(10), list(mixing.TARGETS)
    rows = []
    for i in range(2000):
        own = kinds[0] if i % 33 else kinds[1 + i // 33 % 3]
        spread = rng.uniform(0.1, 0.3)
        cut = sorted(rng.random() for _ in range(2))
        rest = iter([cut[0] * spread, (cut[1] - cut[0]) * spread, (1 - cut[1]) * spread])
        rows.append((rng.randrange(5, 400), *[1 - spread if k == own else next(rest) for k in kinds]))
    soft = spark.createDataFrame(rows, "tokens long, " + ", ".join(f"p_{k} double" for k in kinds))
    got = soft.withColumn("rate", mixing.fit_rates(soft, mixing.TARGETS, least=least)).toPandas()
    assert (got.rate >= least).all()
    sums = {k: (got.tokens * got[f"p_{k}"] * got.rate).sum() for k in kinds}
    for k, w in mixing.TARGETS.items():
        assert sums[k] / sum(sums.values()) == pytest.approx(w, abs=1e-4)


def test_missed_targets_are_reported(spark):
    soft = spark.createDataFrame([(10, 1.0, 0.0), (20, 1.0, 0.0)], "tokens long, p_en double, p_de double")
    with pytest.warns(UserWarning, match="misses its target"):
        mixing.fit_rates(soft, {"en": 0.5, "de": 0.5}, least=1.0)
