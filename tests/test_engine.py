"""The search engine, the agent, the note tools and the settings."""

import json
import sys
import types
import urllib.error

import pytest
from pyspark.sql import functions as F

from folioscope import __main__ as cli
from folioscope import config
from folioscope.operators.store import ChunkStore
from folioscope.functions import text as fx
from folioscope.plans import engine, providers
from folioscope.sources import http, pdf, web


class Fixed:
    def __init__(self, answer):
        self.answer = answer

    def ask(self, prompt):
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    (root / "sub").mkdir()
    (root / "apples.md").write_text("---\ntitle: Apples\ntags: [fruit]\n---\n# Apples\n\nApples grow on trees. See [[pears]].")
    (root / "sub/pears.md").write_text("# Pears\n\nPears are sweet. #fruit")
    (root / "stones.md").write_text("Stones are hard. [[apples]]")
    store = ChunkStore(spark, str(tmp_path_factory.mktemp("db") / "s"), providers.with_embeddings, 16).initialize()
    found = engine.NoteTools(spark, str(root), store, engine.SearchEngine(store, providers.FeatureEmbedder()))
    assert found.synchronise() == {"ADD": 3}
    return found


def test_tools(tools):
    found = tools.search("apples grow trees")
    assert {r["wikilink_name"] for r in found} == {"apples", "pears", "stones"}
    assert set(found[0]) == set(engine.ITEM)
    assert tools.search("pears", tags=["fruit"], path="sub/")[0]["wikilink_name"] == "pears"
    assert tools.search("") == []
    assert tools.list_files() == "apples\nstones\nsub/"
    assert tools.list_files("none").startswith("No files found")
    assert tools.read("pears").startswith("# Pears")
    assert tools.read("sub/pears", 2, 1) == "Pears are sweet. #fruit"


def test_listwise_and_hyde(tools):
    ids = [r["id"] for r in tools.engine.hits("apples").collect()]
    own = engine.SearchEngine(tools.store, providers.FeatureEmbedder(), Fixed("Here is it:\nApples."), Fixed(json.dumps([ids[-1], "none", ids[0]])))
    assert [r["id"] for r in own.hits("apples").collect()] == [ids[-1], ids[0]]
    assert own.passage("apples") == "Apples."
    broken = engine.SearchEngine(tools.store, providers.FeatureEmbedder(), Fixed(RuntimeError()), Fixed("not json"))
    assert [r["id"] for r in broken.hits("apples").collect()] == ids


def test_service_fallback(tools):
    hits = tools.engine.hits("apples")
    n = hits.count()
    scored = engine.with_service(hits, lambda texts: [(i, 1.0 - i / 10) for i in range(1, len(texts))], lambda: hits).collect()
    assert len(scored) == n
    assert scored[-1]["relevance_score"] == 0.0

    def fails(texts):
        raise OSError

    assert engine.with_service(hits, fails, lambda: hits.where(F.lit(False))).count() == 0


def test_summaries_of_long_notes(spark, tmp_path):
    class Says:  # a class of its own, so that executors get it whole
        def __init__(self, answer):
            self.answer = answer

        def ask(self, prompt):
            if self.answer is None:
                raise RuntimeError
            return self.answer

    (tmp_path / "v").mkdir()
    (tmp_path / "v/long.md").write_text("\n\n".join(f"## Part {i}\n" + "sand and salt " * 60 for i in range(4)))
    (tmp_path / "v/short.md").write_text("brief")
    store = ChunkStore(spark, str(tmp_path / "db"), providers.with_embeddings).initialize()
    engine.NoteTools(spark, str(tmp_path / "v"), store, None, Says(" all about sand ")).synchronise()
    found = {(r["wikilink_name"], r["position"]): r for r in store.chunks().collect()}
    assert found["long", -1]["content"] == "all about sand"
    assert found["long", -1]["id"].endswith("_-1")
    assert ("short", -1) not in found
    for broken in (Says("  "), Says(None)):
        store = ChunkStore(spark, str(tmp_path / f"db{id(broken)}"), providers.with_embeddings).initialize()
        engine.NoteTools(spark, str(tmp_path / "v"), store, None, broken).synchronise()
        assert store.chunks().where("position = -1").count() == 0


def test_reranker_that_the_settings_choose(spark):
    model = providers.FeatureEmbedder()
    texts = ["owls nest in barns", "crabs walk on sand", None]
    rows = spark.createDataFrame([(f"c{i}", t, model.embed([t or ""])[0], i + 1) for i, t in enumerate(texts)], "id string, content string, embeddings array<double>, hit_rank int")
    order = lambda **own: [r["id"] for r in engine.reranked(rows, "crabs walk", own.pop("settings"), **own).collect()]
    assert order(settings=config.Config()) == ["c0", "c1", "c2"]
    assert order(settings=config.Config(embedding_reranker="m"), embedder=model)[0] == "c1"
    both = config.Config(embedding_reranker="m", chat_reranker="c")
    assert order(settings=both, embedder=model, chat=providers.WordOverlapChat())[0] == "c1"
    proxy = config.Config(proxy_reranker="p")
    assert order(settings=proxy, service=lambda q, t: [(i, float(i)) for i in range(len(t))]) == ["c2", "c1", "c0"]

    def fails(q, t):
        raise OSError

    assert order(settings=proxy, service=fails) == ["c0", "c1", "c2"]


def test_agent(tools):
    agent = engine.SearchAgent(tools.engine, Fixed("fruit"))
    assert agent.search("what grows?") == "fruit"
    names = {r["wikilink_name"] for r in agent.chunks("apples").collect()}
    assert {"apples", "pears", "stones"} == names
    assert engine.SearchAgent(tools.engine, Fixed(RuntimeError())).search("apples") == engine.NO_ANSWER


def test_config(tmp_path):
    path = tmp_path / ".env"
    path.write_text("# c\nFOLIOSCOPE_VAULT='/v'\nexport FOLIOSCOPE_SEARCH_LIMIT=7\nbad\n")
    own = config.load({"FOLIOSCOPE_SEARCH_LIMIT": "9"}, path)
    assert (own.vault, own.search_limit, own.store_path, own.chunk_most) == ("/v", 9, "/v/.vault_db", 1000)
    with pytest.raises(ValueError, match="positive"):
        config.Config(search_limit=0)
    with pytest.raises(ValueError, match="range"):
        config.Config(min_score=2)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "n.md").write_text("one note")
    assert cli.main(["reindex", "--vault", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out) == {"ADD": 1}
    cli.main(["list", "--vault", str(tmp_path)])
    assert capsys.readouterr().out == "n\n"


class Answer:
    """What urlopen gives."""

    def __init__(self, body, kind="text/plain", status=200):
        self.body, self.headers, self.status = body, {"Content-Type": kind}, status

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self):
        return self.body


def test_http_transports():
    asked = []

    def opener(request, timeout):
        asked.append((request.full_url, request.data, dict(request.headers)))
        if "gone" in request.full_url:
            raise urllib.error.HTTPError(request.full_url, 404, "gone", {}, None)
        if "slow" in request.full_url:
            raise urllib.error.URLError(TimeoutError())
        if "rerank" in request.full_url:
            return Answer(json.dumps({"results": [{"index": 1, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.1}]}).encode())
        return Answer(b"found", "text/html")

    pages = http.Pages(opener)
    assert pages("https://x.org/a") == (200, "text/html", b"found")
    assert pages("https://x.org/gone")[0] == 404
    with pytest.raises(TimeoutError):
        pages("https://x.org/slow")
    assert http.WebSearch(opener=opener).kind == "duckduckgo"
    assert http.WebSearch(opener=opener)("two words") == "found"
    assert asked[-1][1] == b"q=two+words&b=&l=us-en"
    assert http.WebSearch("k", "e", opener=opener)("q") == "found"
    assert asked[-1][0].startswith(http.GOOGLE + "?key=k&cx=e&q=q&num=10")
    assert http.Reranker("https://r.org/", "m", "secret", opener)("q", ["a", "b"]) == [(1, 0.9), (0, 0.1)]
    assert asked[-1][2]["Authorization"] == "Bearer secret"
    with pytest.raises(OSError, match="404"):
        http.Reranker("https://gone.org", "m", "", opener)("q", [])


def test_pdf_text_needs_a_library(monkeypatch):
    class Page:
        def get_text(self, kind):
            return " page text\n"

    class Document(list):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    monkeypatch.setitem(sys.modules, "pymupdf", types.SimpleNamespace(open=lambda stream, filetype: Document([Page(), Page()])))
    assert pdf.as_text("application/pdf", b"%PDF-1") == ("text/plain", "page text\n\npage text")
    monkeypatch.setitem(sys.modules, "pymupdf", None)
    assert pdf.as_text("", b"%PDF-1") == ("application/pdf", "%PDF-")
    assert pdf.as_text("text/html", b"<p>\xff") == ("text/html", "<p>�")


def test_fetch_answers_as_callers_expect(spark):
    def transport(url):
        if "slow" in url:
            raise TimeoutError
        answers = {"https://x.org/json": (200, "application/json", "{}"), "https://x.org/empty": (200, "text/plain", " "), "https://x.org/503": (503, "", ""), "https://x.org/403": (403, "", ""), "https://x.org/pdf": (200, "application/pdf", b"%PDF-1")}
        repo = {"https://raw.githubusercontent.com/a/b/main/README.md": (404, "", ""), "https://raw.githubusercontent.com/a/b/main/README.rst": (200, "text/plain", "found it"), "https://raw.githubusercontent.com/c/d/main/README.md": (500, "", "")}
        return {**answers, **repo, "https://x.org/long": (200, "text/markdown", "y" * 20_000)}.get(url, (200, "text/plain", "late"))

    urls = [f"https://x.org/{x}" for x in ("json", "empty", "503", "403", "pdf", "slow", "long")] + ["https://github.com/a/b", "https://github.com/c/d"]
    got = {r["url"].split("/")[-1]: r["text"] for r in web.fetch(spark.createDataFrame([(u,) for u in urls], "url string"), transport).collect()}
    long = got.pop("long")
    assert got == {"json": fx.ERROR_CONTENT, "empty": fx.ERROR_EMPTY, "503": fx.ERROR_CONTENT, "403": fx.ERROR_4XX, "pdf": fx.ERROR_CONTENT, "slow": fx.ERROR_TIMEOUT, "b": "found it", "d": fx.ERROR_CONTENT}
    assert long == "y" * 15_000 + web.CUT_MARK
