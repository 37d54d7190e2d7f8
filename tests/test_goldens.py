"""Goldens of windows, filters, rerankers, evaluation, URLs and the store."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import htmltext
from folioscope.functions import text as fx
from folioscope.operators import evaluate, rerank, retrieval, windows
from folioscope.operators import store as store_module
from folioscope.operators.store import ChunkStore, ConflictError, NotInitializedError
from folioscope.plans import engine, providers, research
from folioscope.schema import Scope
from folioscope.sources import vault, web

HIT = "document_id string, position int, hit_rank int, relevance_score double"
CHUNK = "document_id string, position int, offset int, content string, tags array<string>, outgoing_links array<string>"


def assembled(spark, hits, positions, reach=1):
    own = spark.createDataFrame([("d", p, i, s) for i, (p, s) in enumerate(hits)], HIT)
    stored = spark.createDataFrame([("d", p, p * 2, f"c{p}", [f"t{p}"], [f"l{p}"]) for p in positions], CHUNK)
    return [r.asDict() for r in windows.assemble(own, stored, reach).orderBy("hit_rank").collect()]


@pytest.mark.parametrize(
    ("hits", "stored", "want"),
    [
        ([(1, None)], [0, 1, 2], [(0, 2)]),
        ([(2, 0.3), (5, 0.8)], [2, 3, 4, 5], [(2, 5)]),
        ([(2, None), (6, None)], [0, 1, 2, 3, 5, 6, 7], [(1, 3), (5, 7)]),
        ([(0, None)], [0, 1], [(0, 1)]),
        ([(-1, None), (2, None)], [0, 1, 2, 3], [(0, 3)]),
        ([(-1, None)], [0, 1], []),
        ([(1, None), (1, 0.5)], [1], [(1, 1)]),
    ],
)
def test_windows(spark, hits, stored, want):
    got = assembled(spark, hits, stored)
    assert [(r["window_start"], r["window_end"]) for r in got] == want


def test_window_content_and_unions(spark):
    (row,) = assembled(spark, [(2, 0.3), (5, 0.8)], [2, 3, 4, 5])
    assert row["content"] == "c2\n\nc3\n\nc4\n\nc5"
    assert row["relevance_score"] == 0.8
    assert row["tags"] == ["t2", "t3", "t4", "t5"]
    assert row["id"] == "d_2"
    (alone,) = assembled(spark, [(1, 0.5)], [0, 1, 2], reach=0)
    assert alone["content"] == "c1"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see [[Tide tables]].", ["Tide tables"]), ("[[tides|the moon's work]]", ["tides"]), ("[[b]][[a]] then [[b]]", ["a", "b"]), ("[[ ]] and [[]]", []), ("![[chart#north|map]]", ["chart"]),
        ("[[kelp forest |x]]", ["kelp forest "]), ("[single] [[open", []), ("[[reef [old] map]]", ["reef [old] map"]),
    ],
)
def test_wikilinks(spark, text, want):
    assert spark.range(1).select(fx.wikilinks(F.lit(text)).alias("x")).first()["x"] == want


@pytest.mark.parametrize(("text", "want"), [("#sea", ["sea"]), ("up #ebb, down #flow", ["ebb", "flow"]), ("#low_tide#high-tide #low_tide", ["high-tide", "low_tide"]), ("# heading #2nd ##", []), ("#NorthSea!", ["NorthSea"])])
def test_hashtags(spark, text, want):
    assert spark.range(1).select(fx.hashtags(F.lit(text)).alias("x")).first()["x"] == want


def test_line_slice(spark):
    def cut(o, n):
        return spark.range(1).select(fx.line_slice(F.lit("a\nb\nc"), o, n).alias("x")).first()["x"]

    assert (cut(0, 2), cut(1, None), cut(9, 1), cut(0, 0)) == ("a\nb\n", "b\nc", "", "")


def test_embedding_rerank_order(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.7, 0.7]), ("c", [0.0, 1.0])], "id string, embeddings array<double>")
    got = rerank.by_embedding(rows, [1.0, 0.0]).orderBy(F.desc("relevance_score")).collect()
    assert [r["id"] for r in got] == ["a", "b", "c"]
    assert got[0]["relevance_score"] == 1.0
    assert rerank.by_embedding(rows.where("id = 'b'"), [1.0, 0.0]).first()["relevance_score"] == 1.0


def test_chat_failure_is_null(spark):
    class Broken:
        def ask(self, prompt):
            raise RuntimeError

    rows = spark.createDataFrame([("p",)], "prompt string")
    assert providers.answers(rows, "prompt", "a", Broken()).first()["a"] is None
    assert providers.hypothetical(Broken(), "q") == "q"
    good = providers.WordOverlapChat().ask("Question: a b\nPassage: a b c")
    assert good == "perfect"


def test_choose():
    assert [rerank.choose(*x) for x in ((True, True, True), (False, True, True), (False, True, False), (False, False, True))] == ["service", "embedding+rubric", "embedding", "fusion"]


def test_evaluation_cases(spark, tmp_path):
    path = tmp_path / "cases.txt"
    path.write_text("head\nwhat : a, b, : c\nskipped\nq : : \n")
    rows = evaluate.cases(spark, str(path)).collect()
    assert [(r["query"], r["expected"], r["unwanted"]) for r in rows] == [("what", ["a", "b"], ["c"]), ("q", [], [])]


NOTES = [
    ("reef_0", "Coral reefs shelter fish and crabs", "Reefs", ["sea", "life"], "sea/reef.md", "reef", 0),
    ("reef_1", "Storms break coral, and crabs hide", "Reefs", ["sea"], "sea/reef.md", "reef", 1),
    ("crab_0", "Crabs walk sideways; crabs eat crabs", "On crabs", ["life"], "sea/crab.md", "crab", 0),
    ("barn_0", "Owls nest in the barn", "The barn", ["farm"], "farm/barn.md", "barn", 0),
    ("owl_0", "An owl eats mice, never crabs", "Owls", ["farm", "life"], "farm/owl.md", "owl", 0),
]


def store_rows(spark, rows=NOTES):
    own = spark.createDataFrame(rows, "id string, content string, title string, tags array<string>, source_path string, wikilink_name string, position int")
    return own.withColumns({"description": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "outgoing_links": F.array().cast("array<string>"), "modified_at": F.lit(1.0), "offset": F.lit(0), "file_size": F.lit(7)})


def opened(spark, path, **options):
    return ChunkStore(spark, str(path), providers.with_embeddings, 64, **options)


def test_store(spark, tmp_path):
    store = opened(spark, tmp_path / "db")
    with pytest.raises(NotInitializedError):
        store.chunks()
    store.initialize().store(store_rows(spark))
    vector = providers.FeatureEmbedder().embed(["crabs"])[0]
    assert [r["id"] for r in store.search("crabs", vector).collect()][0] == "crab_0"
    assert store.search("crabs", vector, limit=2).count() == 2
    assert {r["id"] for r in store.search("crabs", vector, tags=["farm", "life"]).collect()} == {"owl_0"}
    assert store.search("crabs", vector, tags=["farm"], path="sea/").count() == 0
    assert store.search_windows("crabs", vector).count() >= 1
    assert store.by_ids(["reef_1", "none"]).count() == 1
    assert store.by_ids([]).count() == 0
    assert store.sources_by_name("reef") == ["sea/reef.md"]
    store.reindex()
    store.delete(["sea/reef.md", "unknown"])
    assert store.chunks().count() == 3
    assert store.sources().count() == 3


@pytest.mark.parametrize("filters", [{}, {"tags": ["life"]}, {"path": "sea/"}, {"tags": ["sea"], "path": "sea/r"}])
@pytest.mark.parametrize("scope", list(Scope))
def test_index_gives_the_scores_of_a_scan(spark, tmp_path_factory, filters, scope):
    if not hasattr(test_index_gives_the_scores_of_a_scan, "store"):
        own = opened(spark, tmp_path_factory.mktemp("index"), buckets=3).initialize()
        own.store(store_rows(spark, NOTES[:3]))
        own.store(store_rows(spark, NOTES[3:]))
        test_index_gives_the_scores_of_a_scan.store = own
    store = test_index_gives_the_scores_of_a_scan.store
    query = "coral crabs and the owls"
    want = retrieval.full_text(retrieval.scoped(store.chunks(), filters.get("tags", ()), filters.get("path")), query, 10, scope).collect()
    got = store.full_text(query, 10, scope, **filters).collect()
    assert [(r["id"], r["rank"]) for r in got] == [(r["id"], r["rank"]) for r in want]
    assert [r["score"] for r in got] == pytest.approx([r["score"] for r in want])


def test_changes_touch_only_their_buckets(spark, tmp_path):
    store = opened(spark, tmp_path / "db").initialize()
    store.store(store_rows(spark))
    _, before = store._latest()
    store.delete(["farm/owl.md"])
    _, after = store._latest()
    moved = {b for b in before["folders"]["chunks"] if before["folders"]["chunks"][b] != after["folders"]["chunks"].get(b)}
    assert len(moved) == 1
    assert store.full_text("owl", 5).count() == 0
    assert [r["id"] for r in store.full_text("owls", 5).collect()] == ["barn_0"]
    assert len(store.snapshots()) == 2
    assert sum(s[0] for s in after["sizes"].values()) == 4


def test_concurrent_writers_lose_nothing(spark, tmp_path, monkeypatch):
    a, b = opened(spark, tmp_path / "db").initialize(), opened(spark, tmp_path / "db")
    own, raced = a._publish, []

    def slow(version, state):  # another writer commits between this one's work and its commit
        if not raced:
            raced.append(version)
            b.store(store_rows(spark, NOTES[3:]))
        return own(version, state)

    a._publish = slow
    a.store(store_rows(spark, NOTES[:3]))
    assert {r["id"] for r in b.chunks().collect()} == {n[0] for n in NOTES}
    assert not own(a.snapshots()[-1], {})
    a._publish = lambda version, state: False
    monkeypatch.setattr(store_module, "TRIES", 2)
    with pytest.raises(ConflictError):
        a.delete(["sea/reef.md"])


def test_unreadable_files_are_tried_again(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.md").write_text("one")
    (tmp_path / "v/b.md").write_text("two")
    store = opened(spark, tmp_path / "db").initialize()
    tools = engine.NoteTools(spark, str(tmp_path / "v"), store, None)
    files = vault.listing(spark, str(tmp_path / "v")).withColumn("path", F.when(F.col("source_path") == "b.md", "/nowhere/b.md").otherwise(F.col("path")))
    assert store.synchronise(files, tools._chunks, vault.notes) == {"ADD": 2, "FAILED": 1}
    assert [r["source_path"] for r in store.sources().collect()] == ["a.md"]
    assert tools.synchronise() == {"KEEP": 1, "ADD": 1}
    assert sorted(r["content"] for r in store.chunks().collect()) == ["one", "two"]
    newer = files.withColumn("modified_at", F.col("modified_at") + 9)
    assert store.synchronise(newer, tools._chunks, vault.notes) == {"REPLACE": 2, "FAILED": 1}
    assert sorted(r["content"] for r in store.chunks().collect()) == ["one", "two"]  # the old text of the unreadable one stays


def test_vault_sync(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "a.md").write_text("---\ntitle: null\ntags: [x, y]\n---\n# A\n\n[[b]] #z")
    (root / "sub/b.md").write_text("plain [[a|alias]]")
    (root / "sub/_u.md").write_text("")
    (root / ".git/c.md").write_text("no")
    (root / "bad.md").write_text("---\n: [\n---\nrest")
    files = vault.listing(spark, str(root))
    assert {r["source_path"] for r in files.collect()} == {"a.md", "sub/b.md", "sub/_u.md", "bad.md"}
    rows = {r["source_path"]: r for r in vault.notes(files).collect()}
    assert rows["a.md"]["metadata"]["title"] == "None"
    assert rows["a.md"]["tags"] == ["x", "y"]
    assert rows["bad.md"]["content"].startswith("---")
    assert vault.listing(spark, str(root / "none")).count() == 0

    from folioscope.operators import chunking

    def chunk(changed):
        own = chunking.chunks(changed.withColumnRenamed("id", "note"))
        built = chunking.build(own.withColumnRenamed("tags", "nt"), F.col("source_path"), F.col("nt"))
        return built.withColumns({"title": F.col("metadata.title"), "description": F.col("metadata.description"), "source": F.col("metadata.source")})

    store = ChunkStore(spark, str(tmp_path / "db"), providers.with_embeddings).initialize()
    assert store.synchronise(files, chunk, vault.notes) == {"ADD": 4}
    assert store.synchronise(files, chunk, vault.notes) == {"KEEP": 4}
    (root / "sub/b.md").unlink()
    assert store.synchronise(vault.listing(spark, str(root)), chunk, vault.notes) == {"KEEP": 3, "DELETE": 1}
    assert vault.rename_note(spark, str(root), "a.md", "new.md") == 0
    assert [r["entry"] for r in vault.folder(vault.listing(spark, str(root))).collect()] == ["bad", "new", "sub/"]


def test_read_note(spark):
    rows = spark.createDataFrame([("a/n.md", "n", "1\n2\n3"), ("b/n.md", "n", "x"), ("c/m.md", "m", "y")], "source_path string, wikilink_name string, content string")
    assert vault.read_note(rows, "m") == "y"
    assert vault.read_note(rows, "a/n", 1, 1) == "2\n"
    with pytest.raises(ValueError, match="several"):
        vault.read_note(rows, "n")
    with pytest.raises(FileNotFoundError):
        vault.read_note(rows, "q")
    for bad in ("", "x.md", "/x", "../x", "a\\b"):
        assert vault.read_request_error(bad)
    assert vault.read_request_error("x", -1)


def test_fetch(spark):
    def transport(url):
        return {"https://arxiv.org/html/1": (404, "", ""), "https://arxiv.org/pdf/1": (200, "text/plain", "paper"), "https://x.org/": (200, "text/html", "<h1>T</h1><p>b")}[url]

    rows = spark.createDataFrame([("https://arxiv.org/abs/1",), ("https://x.org/",), ("nope",), ("https://gone.org/",)], "url string")
    got = {r["url"]: r["text"] for r in web.fetch(rows, transport).collect()}
    assert got["https://arxiv.org/abs/1"] == "paper"
    assert got["https://x.org/"] == "# T\n\nb"
    assert got["nope"] == "ERROR: invalid URL"
    assert got["https://gone.org/"].startswith("ERROR")


def test_research(spark):
    class Planner:
        def __init__(self):
            self.rounds = 0

        def queries(self, question):
            return ["one", "https://x.org/b"]

        def clean(self, query, sources, gap):
            return f"{query}: {len(sources)}{gap}"

        def recover(self, query, failed, gap):
            return research.NOTHING

        def reflect(self, question, findings):
            self.rounds += 1
            return self.rounds > 1, " for the gap", ["more"]

        def answer(self, question, findings):
            return "; ".join(findings), ""

    def search(branches):
        return branches.where("not is_url").select("n", F.posexplode(F.array(F.lit("https://x.org/a"), F.lit("https://bad.org/"))).alias("place", "url"))

    def transport(url):
        return (200, "text/plain", url) if "x.org" in url else (500, "", "")

    report = research.research(spark, "q", Planner(), search, transport)
    assert report.answer == "one: 1; https://x.org/b: 1; more: 1 for the gap"
    with pytest.raises(ValueError, match="unknown kind"):
        research.researcher("other", spark, Planner(), search, transport)
    assert research.researcher("deep_research", spark, Planner(), search, transport)("q").sources == report.sources
    assert report.sources == ["https://x.org/a", "https://x.org/b"]
    assert research.should_stop(False, 3, ["x"])
    assert research.merged_evidence("a", "b") == "a\n\nb"


def test_rename_skips_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "a.md").write_text("me")
    (tmp_path / "b.md").write_text("to [[a]] and [[A|x]]")
    (tmp_path / "c.md").write_bytes(b"\xff\xfe [[a]]")
    assert vault.rename_note(spark, str(tmp_path), "a.md", "sub/z.md") == 1
    assert (tmp_path / "b.md").read_text() == "to [[z]] and [[z|x]]"
    assert (tmp_path / "c.md").read_bytes() == b"\xff\xfe [[a]]"
    assert (tmp_path / "sub/z.md").read_text() == "me"


def test_evaluation_means(spark):
    rows = spark.createDataFrame([(1.0, 0.5, 0.6, None), (0.0, 1.0, 0.4, None), (0.0, 0.0, 0.0, "failed")], "precision double, recall double, f_score double, error string")
    row = evaluate.means(rows).first()
    assert (row["cases"], row["precision"], row["recall"], row["f_score"], row["grade"]) == (2, 0.5, 0.75, 0.5, "good")
    ranks = spark.createDataFrame([(1.0, 0.4), (0.0, 0.8)], "position_accuracy double, overlap_accuracy double")
    assert evaluate.mean_agreement(ranks).first()["overlap_accuracy"] == pytest.approx(0.6)


def test_embedder_places_alike_texts_near():
    a, b, c = providers.FeatureEmbedder().embed(["crabs walk on sand", "crabs walk on the sand", "owls nest in barns"])
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    assert dot(a, a) == pytest.approx(1)
    assert dot(a, b) > 0.5 > dot(a, c)
    assert providers.FeatureEmbedder(8).embed([""]) == [[0.0] * 8]


def test_planner_that_asks_a_model(spark):
    class Model:
        def __init__(self, *replies):
            self.replies, self.prompts = list(replies), []

        def ask(self, prompt):
            self.prompts.append(prompt)
            return self.replies.pop(0)

    model = Model('["a", " ", "https://x.org"]', "1. one\n- two", " kept ", "read", '{"is_sufficient": false, "knowledge_gap": "when", "follow_up_queries": ["b"]}', "no json", "Yes.\n\nBecause.")
    planner = research.ChatPlanner(spark, model)
    assert planner.queries("q") == ["a", "https://x.org"]
    assert planner.queries("q") == ["one", "two"]
    assert planner.clean("q", ["s1", "s2"], "where") == "kept"
    assert "Knowledge gap: where" in model.prompts[-1]
    assert "s1\n\ns2" in model.prompts[-1]
    assert planner.recover("q", [f"u{i}" for i in range(9)], "") == "read"
    assert "4. u3" in model.prompts[-1]
    assert "u4" not in model.prompts[-1]
    assert "Knowledge gap" not in model.prompts[-1]
    assert planner.reflect("q", ["f"]) == (False, "when", ["b"])
    assert planner.reflect("q", ["f"]) == (True, "", [])
    assert planner.answer("q", ["f"]) == ("Yes.", "Because.")


def test_markdown():
    assert htmltext.to_markdown("<h2>T</h2><ul><li>a<li>b</ul><script>x</script><p>q <b>r</b> <a href='u'>s</a>") == "## T\n\n* a\n* b\n\nq **r** [s](u)"
    assert htmltext.to_markdown(None) is None


def test_bm25_without_terms(spark):
    rows = spark.createDataFrame([(1, "a b")], "id int, content string")
    assert retrieval.bm25(rows, "").count() == 0
