"""Search, media, quality, near-dedup, pages, packing and chat against brute force, round trips and held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import ann, chat, html, media, packing, quality, registry, simhash, webp
from folioscope.llm.tokens import Encoder, byte_table

PATH = registry.tokenizer_path()
ODD = ["", "a", "a  b", "x\n\ny", " lead", "tail ", "a\tb", "<|endoftext|> hi", "é ü\nñ b's 've 12 3!!! a_b", "日本 語", "a b", "Word. " * 3000, "\\n <|im_end|> \\| <\\|", "😀 😀"]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# ---- tokens and packing ----


def test_encoder_equals_tokenizer():
    encoder, table = Encoder(PATH), byte_table(PATH)
    for text in ODD:
        ids = np.frombuffer(encoder.encode(text), "<u4")
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert b"".join(table[i] for i in ids).decode() == text


def test_best_cuts_is_optimal():
    rng = random.Random(2)
    for _ in range(150):
        window = rng.choice([8, 16, 32])
        pos, pen = [0], [0.0]
        for _ in range(rng.randrange(1, 25)):
            pos.append(pos[-1] + rng.randrange(1, window // 2 + 1))
            pen.append(rng.choice([0.0, 1.0, 5.0]))

        def padding(n, w=window):
            return 0 if n & (n - 1) == 0 else w - n

        best = [0.0] + [float("inf")] * (len(pos) - 1)
        for j in range(1, len(pos)):
            best[j] = min((best[i] + padding(pos[j] - pos[i]) + pen[j] for i in range(j) if pos[j] - pos[i] <= window), default=float("inf"))
        cuts = packing.best_cuts(pos, pen, window)
        assert cuts[0] == 0
        assert cuts[-1] == len(pos) - 1
        cost = sum(padding(pos[b] - pos[a]) + pen[b] for a, b in zip(cuts, cuts[1:], strict=False))
        assert cost == pytest.approx(best[-1])


def test_packing_round_trip(spark):
    rng = random.Random(3)
    texts = ODD + [None] + [" ".join(rng.choice(["one", "two.", "three", "fünf!"]) for _ in range(rng.randrange(1, 4000))) for _ in range(30)] + ["nopunctuation" * 3000]
    rows = packing.pack(docs_of(spark, texts).withColumn("start", F.lit("x")), PATH).toPandas()
    tokenizer = Encoder(PATH).tokenizer
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.start.tolist() == np.cumsum([0, *own.length])[:-1].tolist()
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == ids
        assert set(own.doc_tokens) == {len(ids)}
        assert [zlib.crc32(bytes(x)) for x in own.ids] == own.ids_crc32.tolist()
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.cumsum([0, *own.length])[:-1].tolist()
        assert own.length.sum() <= 2048
    assert packing.pack(docs_of(spark, ["a"]).limit(0), PATH).count() == 0
    twice = docs_of(spark, ["same text here."]).union(docs_of(spark, ["same text here."])).union(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    again = packing.pack(twice.coalesce(1), PATH).toPandas()
    assert again.doc_id.isna().sum() == 1
    assert again.groupby("doc_id").length.sum().tolist() == [2 * again[again.doc_id == 0].doc_tokens.iloc[0]]


# ---- media ----


def test_webp_round_trips_every_feature():
    rng = np.random.default_rng(1)
    for trial in range(120):
        h, w, n = int(rng.integers(1, 20)), int(rng.integers(1, 30)), int(rng.choice([1, 2, 3, 4, 10, 16, 40, 250]))
        colours = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        image = colours[rng.integers(0, n, (h, w))] if trial % 2 else rng.integers(0, 1 << 32, (h, w), dtype=np.uint64).astype(np.uint32)
        options = {
            "predictor": [None, -1, 11, 1, 13, 5, 12][trial % 7], "cross": [None, (3, -7, 100)][(trial // 2) % 2], "green": bool((trial // 3) % 2), "palette": bool(trial % 2),
            "cache_bits": [0, 4, 0, 9][trial % 4], "lz": bool((trial // 5) % 2), "groups": [1, 1, 3][trial % 3],
        }
        assert (webp.decode(webp.encode(image, **options)) == image).all(), options


def test_fast_and_slow_decoders_agree():
    rng = np.random.default_rng(2)
    image = (0xFF000000 | rng.integers(97, 123, (9, 64)) << 16 | rng.integers(97, 123, (9, 64)) << 8 | 7).astype(np.uint32)
    data = webp.encode(image, lz=True)
    fast = webp.decode(data)
    own = webp._fast
    try:
        webp._fast = lambda bits, w, h, codes: webp._slow(bits, w, h, [codes], None, 0, 0, 0)
        assert (webp.decode(data) == fast).all()
    finally:
        webp._fast = own
    assert (fast == image).all()
    with pytest.raises(ValueError):
        webp.decode(b"RIFF")


def test_smallest_file_round_trips_and_uses_each_method():
    rng = np.random.default_rng(3)
    prose = "".join(rng.choice(list("etaoin shrdlu"), 6000))
    line = prose[:600]

    def stored(raw):
        raw = raw + b" " * (-len(raw) % 192)
        x = np.frombuffer(raw, np.uint8).reshape(-1, 64, 3).astype(np.uint32)
        image = 0xFF000000 | x[..., 0] << 16 | x[..., 1] << 8 | x[..., 2]
        out = webp.encode_smallest(image)
        assert (webp.decode(out) == image).all()
        return out, webp.encode(image), image

    for raw in (b" ", b"a" * 5000, prose.encode(), bytes(range(256)) * 9, rng.bytes(9999)):
        stored(raw)
    out, plain, image = stored((line + prose + line + prose[:3000]).encode())
    assert len(out) < 0.8 * len(plain)  # back-references
    assert webp.find_copies(image.reshape(-1))
    out, plain, _ = stored((rng.integers(0, 256, 3000)[:, None] + rng.integers(0, 3, (3000, 3))).astype(np.uint8).tobytes())
    assert len(out) < 0.9 * len(plain)  # subtract green or cross-colour
    ramp = np.cumsum(rng.integers(0, 3, (40, 64, 3)), 1).astype(np.uint8)
    assert webp.transforms((0xFF000000 | ramp[..., 0].astype(np.uint32) << 16 | ramp[..., 1].astype(np.uint32) << 8 | ramp[..., 2]).astype(np.uint32))
    out, plain, _ = stored(ramp.tobytes())
    assert len(out) < 0.7 * len(plain)  # predictor
    few = np.frombuffer(b"abcxyzijk", np.uint8).reshape(3, 3)[rng.integers(0, 3, 4096)]
    out, plain, _ = stored(few.tobytes())
    assert len(out) < 0.7 * len(plain)  # palette


def test_decoder_reads_a_file_made_by_hand():
    """One pixel wide, two high, no transforms: simple codes give both pixels without any bits."""
    bits = "".join(f"{v:0{n}b}"[::-1] for v, n in [(0x2F, 8), (0, 14), (1, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1), *[x for v in (7, 9, 200, 255) for x in ((1, 1), (0, 1), (1, 1), (v, 8))], (1, 1), (0, 1), (0, 1), (0, 1)])
    body = int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")
    data = b"RIFF" + (12 + len(body) + len(body) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    assert webp.decode(data).tolist() == [[255 << 24 | 9 << 16 | 7 << 8 | 200]] * 2


def test_media_of_empty_and_clashing_tables(spark):
    docs = docs_of(spark, ["a"]).withColumns({"media": F.lit("x"), "payload": F.lit(1), "feature": F.lit(2), "n_bytes": F.lit(3)})
    (row,) = media.read_back(media.store_texts(docs)).collect()
    assert bytes(row["payload"]) == b"a" + b" " * 191
    assert media.read_back(media.store_texts(docs.limit(0))).count() == 0


def test_near_table_of_distances():
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert len(webp.NEAR) == 120
    assert webp.NEAR[-1] == (8, 7)


def test_media_payloads(spark):
    texts = [*ODD, None, "x" * 192, "y" * 193, "same", "same"]
    rows = {r["doc_id"]: r for r in media.read_back(media.store_texts(docs_of(spark, texts))).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert bytes(rows[i]["payload"]) == payload
        assert rows[i]["n_bytes"] == len(raw)
    assert bytes(rows[len(texts) - 1]["media"]) == bytes(rows[len(texts) - 2]["media"])
    assert rows[len(texts) - 1]["feature"] == rows[len(texts) - 2]["feature"]
    long = bytes(range(192)) * (media.MOST_ROWS + 3)
    assert b"".join(p.tobytes() for p in media.to_pixels(media.to_files(long))) == long


# ---- quality ----


def test_quality_on_held_out_labels(spark, small):
    got = registry.op3_quality(spark, small.replace("0.001", "0.01")).toPandas()
    labels = spark.read.parquet(f"{small.replace('0.001', '0.01')}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    out = both[both.held_out]
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (out.predicted == out.quality).mean() >= 0.95
    assert got.score.between(0, 1).all()


def test_quality_edges(spark):
    machine = quality.Machine()
    texts = docs_of(spark, [None, "", "é" * 10, "w " * 50_000, "same", "same"]).withColumn("score", F.lit("clash"))
    rows = quality.score(texts, machine).collect()
    assert len(rows) == 6
    none = spark.createDataFrame([], "doc_id long, quality int")
    fitted = quality.fit(docs_of(spark, ["a"]), none)
    assert quality.score(docs_of(spark, ["a", None]), fitted).select("score").distinct().count() >= 1
    assert quality.score(docs_of(spark, ["a"]).limit(0), fitted).count() == 0


def test_machine_equals_pairwise_sum():
    machine = quality.Machine(rank=3)
    rng = np.random.default_rng(1)
    machine.w = rng.normal(size=quality.SIZE).astype(np.float32)
    index, value = quality.features("some words, and some more words!\nTwo lines")
    pairs = sum(float(machine.v[a] @ machine.v[b]) * x * y for i, (a, x) in enumerate(zip(index, value, strict=True)) for b, y in list(zip(index, value, strict=True))[:i])
    assert machine.raw(index, value) == pytest.approx(machine.w0 + float(machine.w[index] @ value) + pairs, rel=1e-3, abs=1e-3)


# ---- near-dedup ----


def brute_components(texts):
    import xxhash

    prints = []
    for t in texts:
        w = (t or "").encode().lower().split()
        if not w:
            prints.append(0)
            continue
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return prints, [root(i) for i in range(len(texts))]


def test_simhash_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 16)  # large shards are dealt out as several trees
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = [None, "", " \n", "A b C", "a B c", "one", "one two"]
    for k in range(150):
        own = list(base)
        for _ in range(k % 4):
            own[rng.randrange(120)] = f"x{rng.randrange(99)}"
        texts.append(" ".join(own))
    texts += [" ".join(f"v{rng.randrange(900)}" for _ in range(40)) for _ in range(60)]
    prints, roots = brute_components(texts)
    got = {r["doc_id"]: r for r in simhash.groups(docs_of(spark, texts)).collect()}
    assert [got[i]["fp"] & (1 << 64) - 1 for i in range(len(texts))] == prints
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert simhash.survivors(docs_of(spark, texts).withColumn("fp", F.lit(1))).columns == ["doc_id", "text", "fp"]
    assert simhash.groups(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_simhash_of_a_very_long_text(spark):
    rng = random.Random(10)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(150_000))
    prints, _ = brute_components([long])
    got = simhash.groups(docs_of(spark, [long, long + " tail", "x"])).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["fp"] & (1 << 64) - 1 == prints[0]
    assert by[1]["component_id"] == 0
    assert by[2]["component_id"] == 2


def test_split_shards_keep_every_link(spark, monkeypatch):
    """One hot shard: all fingerprints agree in two blocks, and links lie in any of the other bits."""
    rng = random.Random(11)
    values = {rng.getrandbits(38) << 26 | 5 for _ in range(300)}
    for v in list(values)[:100]:
        values.add(v ^ 1 << rng.randrange(26, 64) ^ 1 << rng.randrange(26, 64) ^ 1 << rng.randrange(26, 64))
    values = sorted(values)
    monkeypatch.setattr(simhash, "MOST", 64)
    edges = simhash.links(spark.createDataFrame([(v - (v >> 63 << 64),) for v in values], "fp long"))
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    signed = [v - (v >> 63 << 64) for v in values]
    root = {v: v for v in signed}
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                old, new = max(root[signed[i]], root[signed[j]]), min(root[signed[i]], root[signed[j]])
                root = {k: new if r == old else r for k, r in root.items()}
    assert {k: r for k, r in root.items() if k != r} == got


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(9)
    values = list({rng.getrandbits(12) for _ in range(400)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:60]:
        for radius in (0, 1, 3):
            assert sorted(tree.values[i] for i in tree.find(q, radius)) == sorted(v for v in values if (v ^ q).bit_count() <= radius)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201))
    assert got[501] == 500


# ---- search ----


def test_search_recall_and_order(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16))
    x[300:330] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0]), (None, [1.0] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(vectors, F.col("vec_id") % 100 == 0).toPandas()
    hits = total = 0
    for q in range(0, 1200, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(1200), d)) if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert own.score.tolist() == pytest.approx([d[i] for i in own.vec_id])
        assert own.score.is_monotonic_increasing
        hits += len(set(own.vec_id) & set(order))
        total += 10
    assert hits / total >= 0.9
    assert got[got.query_id == 300].sort_values("rank").vec_id.tolist() == [7, *range(301, 310)]
    assert set(got.query_id) == set(range(0, 1200, 100))
    few = ann.search(vectors.where("vec_id < 4"), F.col("vec_id") == 0).toPandas()
    assert sorted(few.vec_id) == [1, 2, 3]
    assert ann.search(vectors.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize(("width", "most"), [(8, 40), (16, 64), (8, 10**6)])
def test_probes_of_parts_equal_a_scan(width, most):
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    codes[100:400, :2] = 7  # hot buckets
    m, rows = 64 // width, np.arange(500)
    values = codes if width == 8 else codes.view(np.uint16)
    layout = ann.Layout(width, np.stack([np.bincount(v, minlength=1 << width) for v in values.T]), most)
    own = [layout.parts_of_row(v, int(r)) for v, r in zip(values, rows, strict=True)]
    parts = {p: ann.Part(layout, p, rows[held], rows[held], np.zeros((len(held), 2)), codes[held]) for p in range(layout.parts) if (held := [r for r in rows if p in own[r]])}
    assert all(sum(len(order) for order, _, _ in p.entries) <= most for p in parts.values())
    assert {r for p in range(layout.first_table) if p in parts for r in parts[p].rows.tolist()} == set(range(500))
    for radius in (0, 3, 8, 17, 26, 33, 64):
        reach = ann.reaches(radius, m)
        want = np.flatnonzero(np.unpackbits(codes ^ codes[5], axis=1).sum(1) <= radius)
        got = {r for p in layout.parts_of_query(values[5], reach) if p in parts for r in parts[p].rows[parts[p].within(codes[5], radius, reach)].tolist()}
        assert sorted(got) == want.tolist()


def recall(got, x, queries):
    hits = 0
    for q in queries:
        d = ((x - x[q]) ** 2).sum(1)
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        hits += len(set(got[got.query_id == q].vec_id) & set(order))
    return hits / (10 * len(queries))


def test_search_of_clustered_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(200, 32))
    x = centres[rng.integers(0, 200, 20_000)] + 0.25 * rng.normal(size=(20_000, 32))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumns({"row": F.lit("x"), "part": F.lit(1), "code": F.lit(2)})
    seen = []
    own = ann.radius_of
    monkeypatch.setattr(ann, "radius_of", lambda *a: seen.append(own(*a)) or seen[-1])
    got = ann.search(vectors, F.col("vec_id") % 500 == 0, part=4000).toPandas()
    assert recall(got, x, range(0, 20_000, 500)) >= 0.9
    codes = ann.Codes(x[:8192])
    mine = codes.encode(x)
    share = np.mean([(ann.far(mine, mine[q]) <= seen[0]).mean() for q in range(0, 20_000, 500)])
    assert share < 0.02  # the radius covers few other rows


def test_search_falls_back_for_lone_queries(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.ones((300, 8)) + 0.01 * rng.normal(size=(300, 8)), -5 * np.eye(8)[:1]])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(vectors, F.col("vec_id") == 300).toPandas()
    assert recall(got, x, [300]) == 1.0
    twice = ann.search(vectors.union(vectors), F.col("vec_id") == 300).toPandas().sort_values("rank")
    assert twice["rank"].tolist() == list(range(1, 11))
    assert (twice.vec_id.value_counts() == 2).all()  # repeated ids are rows of their own


# ---- pages ----


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<p>b<br>c", "a\n\nb\nc"), ("<ul><li>a<li>b<ul><li>c</ul></ul>x", "- a\n- b\n  - c\n\nx"), ("<ol start=3><li>k<li hidden>z<li>m</ol>", "3. k\n4. m"),
        ("<table><tr><th>x<th>long<tr><td>wide cell<td>2</table>", "x         | long\nwide cell | 2"), ("<pre>  a\n   b</pre>", "  a\n   b"), ("<div style='display: none'>no</div>yes", "yes"),
        ("<title>t</title><script>s</script><style>q</style>a &amp; b<!-- c -->", "a & b"), ("a<b>b</b> <i>c</i>", "ab c"), ("", ""), ("x < y", "x < y"), ("<td>x<td>y", "x\ny"), ("<!-- open", ""),
        ("<dl><dt>T<dd>D</dl>", "T\n  D"), ("<table><tr><td colspan=2>ab<tr><td>c<td>d</table>", "ab\nc | d"), ("</p>a</div>b", "ab"), ("<noscript>n</noscript><template>t</template>v", "v"),
    ],
)
def test_html(page, want):
    assert html.extract(page) == want


def test_html_keeps_all_words_when_deep(spark):
    assert html.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html.extract("<table><tr><td>" * 300 + "x").count("x") == 1
    rows = spark.createDataFrame([(1, None), (2, "<p>a"), (2, "<p>a"), (None, "b")], "page_id long, html string").withColumn("text", F.lit(0))
    assert sorted((str(r["page_id"]), r["text"]) for r in html.texts(rows).collect()) == [("1", ""), ("2", "a"), ("2", "a"), ("None", "b")]


# ---- chat ----


def test_chat_round_trip(spark):
    rng = random.Random(5)
    turns = []
    for c in range(60):
        for t in range(rng.randrange(1, 6)):
            text = "shared start" if t == 0 and c % 3 else rng.choice([*ODD[:-4], ODD[-2], None, registry.CONTROL])
            turns.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    turns += [(100, 0, None, "x"), (100, 0, "a\nb", "tie"), (None, 0, "assistant", "no id"), (101, 1, "assistant", "p"), (101, 1, "assistant", "p")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1))
    packs = chat.pack(rows, PATH, most_tokens=3000)
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(packs, PATH)).collect()}
    by: dict = {}
    for c, t, r, x in turns:
        by.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c]["loss_chars"] == len(loss)
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(chat.START + chat.escape(r, True) + "\n" + chat.escape(x) + chat.END + "\n") for _, r, x in own)


def test_chat_shares_prefixes(spark):
    rows = spark.createDataFrame([(c, t, "user", "same start" if t == 0 else f"own {c}") for c in range(50) for t in range(2)], "conv_id long, turn long, role string, text string")
    packs = chat.pack(rows.coalesce(1), PATH).collect()
    assert sum(len(p["node_start"]) for p in packs) == 50 + len(packs)
    for p in packs:
        positions, tokens = np.frombuffer(p["positions"], "<u4"), np.frombuffer(p["tokens"], "<u4")
        assert len(positions) == len(tokens)
        for n, spans in zip(p["conv_nodes"], (p["attends"][n] for n in p["conv_nodes"]), strict=True):
            path = [i for s, e in zip(spans[::2], spans[1::2], strict=True) for i in range(s, e)]
            assert positions[path].tolist() == list(range(len(path)))
            assert spans[-2:] == [p["node_start"][n], p["node_end"][n]]
    assert chat.digests(chat.read_back(chat.pack(rows.limit(0), PATH), PATH)).count() == 0


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(["\\", "<", "|", "n", "\n", "<|im_end|>", "x"]) for _ in range(rng.randrange(12)))
        for role in (False, True):
            safe = chat.escape(text, role)
            assert "<|" not in safe
            assert chat.unescape(safe) == text
