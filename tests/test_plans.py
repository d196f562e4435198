"""The engine as a whole, and what it is made of: ingest, search, assets, exports, reranking, models, evaluation."""

import json

import pytest

from mnemolake.functions import models
from mnemolake.functions.embedding import hash_embedder
from mnemolake.operators import assets, evaluation, exports, rerank, search, tracker
from mnemolake.plans import ingest
from mnemolake.plans.engine import Engine


def _line(kind, text, session="abcdefgh-1"):
    return json.dumps({"type": kind, "message": {"content": text}, "timestamp": "2024-01-01T00:00:00Z", "sessionId": session})


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("engine")
    turns = top / "turns"
    turns.mkdir()
    (turns / "a.jsonl").write_text("\n".join([_line("user", "How do we deploy the harbour crane controller to production?"), _line("assistant", "Deploy the crane controller with the blue pipeline, then watch the harbour dashboard. " * 40), _line("user", "And what of the backup plan for the lighthouse?"), "no json"]))
    notes = top / "notes"
    notes.mkdir()
    (notes / "n.md").write_text("# Lighthouse\nThe lighthouse lamp is changed every spring by two keepers.\n\n## Crane\n" + "The crane is oiled on Mondays and checked by the harbour master. " * 60)
    return Engine(spark, str(top / "store"), hash_embedder(32), 32), top


def test_ingest_reads_pairs_cuts_and_marks(spark, engine):
    e, top = engine
    assert [ingest.detect(spark, str(top / x)) for x in ("turns", "notes")] == ["cc", "markdown"]
    one, two = e.ingest(str(top / "turns"), "2024-01-01"), e.ingest(str(top / "notes"), "2024-01-02")
    rows = e.store.read().collect()
    assert one["files"] == two["files"] == 1 and one["chunks"] + two["chunks"] == len(rows) and one["chunks"] >= 3 and two["chunks"] >= 4
    assert one["broken"] == 1 and one["cut"] >= 1 and one["embedded"] == one["chunks"]
    assert all(len(r.vector) == 32 and len(r.text) <= 2000 for r in rows) and {r.scope for r in rows} == {"cc:abcdefgh", "memory"}
    assert e.ingest(str(top / "notes"), "2024-01-03")["files"] == 0 and tracker.stats(e.store.ledger()).first().files == 2
    (top / "notes" / "n.md").write_text("# Lighthouse\nThe lighthouse lamp is now changed every autumn by three keepers.")
    assert e.ingest(str(top / "notes"), "2024-01-04") == {"files": 1, "chunks": 1, "cut": 0, "broken": 0, "embedded": 1}
    assert e.store.read().where("scope = 'memory'").count() == 1 and {r.n for r in e.store.read().groupBy("id").count().withColumnRenamed("count", "n").collect()} == {1}


def test_search_views_assets_and_exports(spark, engine):
    e, _ = engine
    found = e.search("lighthouse lamp keepers", limit=3).orderBy("position").collect()
    assert found and "lighthouse" in found[0].text.lower() and e.search("hi").count() == 0
    assert "why" in e.explain("lighthouse lamp keepers").first().text and e.rows("lighthouse lamp keepers").columns[0] == "position"
    told = e.distill("lighthouse lamp keepers").first()
    assert told.hits >= 1 and told.sources and told.takeaways
    brief = e.brief("lighthouse lamp keepers", "2024-02-01T00:00:00.000Z").first()
    assert e.briefs().first().id == brief.id and e.clean().count() == 0
    pin = e.pin(found[0].id, "2024-02-02T00:00:00.000Z").first()
    stored = {r.id: r for r in e.store.read().collect()}
    assert stored[found[0].id].importance == pytest.approx(0.95) and {"decision"} == {r.category for r in stored.values() if r.scope.startswith("asset:")}
    assert e.get_pin(pin.id[:6]).first().id == pin.id and [r.id for r in e.pins().collect()] == [pin.id]
    lines = [r.line for r in e.assets().collect()]
    assert len(lines) == 2 and lines[0].startswith(pin.id[:8] + "  pin  ") and lines[1].startswith(brief.id[:8] + "  brief") and e.assets("nothing like it").count() == 0
    for kind in ("md", "json"):
        e.export("lighthouse lamp", "2024-02-03T04:05:06.000Z", kind=kind)
    listed = e.exports().orderBy("format").collect()
    assert [(r.format, r.query, r.created_at) for r in listed] == [(k, "lighthouse lamp", "2024-02-03T04:05:06.000Z") for k in ("json", "md")] and e.exports("nothing like it").count() == 0
    assert e.test()[0] and e.failures == [] and not Engine(spark, e.path, lambda texts: 1 / 0).test()[0]
    with pytest.raises(ValueError):
        Engine(spark, " ", hash_embedder())


def test_dirty_briefs_are_archived(spark, engine):
    e, _ = engine
    bad = spark.createDataFrame([("bad00000x", "t", "s", "q", "p", "2024-03-01", 1, [("asset", 1)], [], [], [], [])], assets.BRIEF)
    assets.save(bad, f"{e.path}/briefs")
    e.store.append(spark.createDataFrame([("x", [0.5] * 32, "asset:brief:bad00000")], "text string, vector array<float>, scope string"), 1)
    assert [r.id for r in e.clean(remove=True).collect()] == ["bad00000x"]
    assert e.clean().count() == 0 and e.briefs().count() == 1 and e.store.read().where("scope = 'asset:brief:bad00000'").count() == 0


def test_cross_encoder_and_its_failures(spark, engine):
    e, _ = engine
    asked = []

    def scorer(query, texts):
        asked.append((query, len(texts)))
        return [(len(texts) - 1, 1.0), (99, 1.0)]

    one = Engine(spark, e.path, hash_embedder(32), 32, scorer=scorer, rerank="cross-encoder", hard_min_score=0.0)
    two = Engine(spark, e.path, hash_embedder(32), 32, scorer=lambda q, t: 1 / 0, rerank="cross-encoder", hard_min_score=0.0)
    plain = Engine(spark, e.path, hash_embedder(32), 32, hard_min_score=0.0)
    ids = lambda x: [r.id for r in x.search("harbour crane controller", limit=4).orderBy("position").collect()]
    assert ids(two) == ids(plain) and ids(one) and asked and asked[0][0] == "harbour crane controller"


def test_rerank_requests_and_responses():
    assert rerank.request("pinecone", "m", "q", ["a"])["documents"] == [{"text": "a"}] and rerank.request("voyage", "m", "q", ["a", "b"])["top_k"] == 2 and rerank.request("jina", "m", "q", ["a"])["top_n"] == 1
    assert rerank.response("jina", {"results": [{"index": 1, "relevance_score": 0.5}, {"index": "x", "relevance_score": 1}]}) == [(1, 0.5)]
    assert rerank.response("pinecone", {"data": [{"index": "0", "score": "0.25"}]}) == [(0, 0.25)] and rerank.response("voyage", {"data": 3}) is None


def test_models():
    assert models.dimensions("nomic-embed-text") == 768 and models.dimensions("any", 5) == 5 and models.with_env("a${X}b", {"X": "1"}) == "a1b"
    for wrong in (lambda: models.dimensions("any"), lambda: models.with_env("${X}", {"X": ""})):
        with pytest.raises((ValueError, KeyError)):
            wrong()
    bodies = []
    t = models.TaskEmbedder(lambda b: bodies.append(b) or [[0.0, 1.0]] * len(b["input"]), "any", "ask", None, 2)
    assert t.embedder("query")(["x"]) == [[0.0, 1.0]] and t.embedder()(["x", "y"]) and [b.get("task") for b in bodies] == ["ask", None] and bodies[0]["dimensions"] == 2
    assert t.test() == (True, "2") and not models.TaskEmbedder(lambda b: [[0.0]], "any", size=2).test()[0]


def test_exports_that_are_broken_are_left_out(spark):
    files = spark.createDataFrame([("a/x.json", "{no", "2024-01-01"), ("a/y.json", "{}", "2024-01-01"), ("a/z.md", "- Query: q\n", "2024-01-02")], "file string, content string, modified string").selectExpr("file", "content", "cast(modified as timestamp) as modified")
    assert sorted((r.id, r.query, r.profile, r.summary) for r in exports.parse_exports(files).collect()) == [("y", "", "default", ""), ("z", "q", "default", "")]


def test_evaluation_cases_and_report(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"name": "n", "query": "q", "expectAny": ["lamp"]}, {"name": "m", "query": "q", "forbid": ["lamp"]}]))
    cases = evaluation.read_cases(spark, str(tmp_path / "c.json"))
    results = spark.createDataFrame([(n, 1, "memory", "a lamp", "") for n in "nm"], "name string, position int, scope string, text string, metadata string")
    lines = evaluation.report(evaluation.score_cases(cases, results), "now")
    assert "- Passed: 1/2" in lines and "| n | 100% | yes | 1 |" in lines


def test_index_reads_only_the_terms_parts(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i % 50} the lamp {i}", "global") for i in range(300)], "id long, text string, scope string")
    search.write_index(df, str(tmp_path / "i"))
    got = search.bm25_from_index(str(tmp_path / "i"), df, ["word7", "lamp"], 5)
    assert [r.id for r in got.orderBy("rank").collect()] == [r.id for r in search.bm25_topk(df, ["word7", "lamp"], 5).orderBy("rank").collect()]
    assert "part#" in got._jdf.queryExecution().toString() and "PartitionFilters: [part" in got._jdf.queryExecution().toString()


def test_auto_source_is_the_busiest_folder(spark, tmp_path):
    from mnemolake.plans.ingest import busiest_folder, source_folder

    top = tmp_path / "projects"
    assert busiest_folder(spark, str(top)) is None  # not there
    top.mkdir()
    assert busiest_folder(spark, str(top)) is None  # empty
    for folder, names in {"a": ["1.jsonl", "x.txt", "y.txt"], "b b": ["1.jsonl", "2.jsonl"], "c": ["1.jsonl", "2.jsonl"], "d/deep": ["1.jsonl", "2.jsonl", "3.jsonl"], ".": ["1.jsonl", "2.jsonl", "3.jsonl", "4.jsonl"]}.items():
        (top / folder).mkdir(parents=True, exist_ok=True)
        for n in names:
            (top / folder / n).write_text("{}")
    found = source_folder(spark, "auto", "cc", str(top))
    assert found.endswith("/projects/b b") and source_folder(spark, "auto", "markdown", str(top)) == f"{found}/memory"
    assert source_folder(spark, "/in/x", None) == "/in/x" and not source_folder(spark, "~/x", "cc").startswith("~")
    for path, kind in ((str(top), "codex"), (str(tmp_path / "none"), "cc")):
        with pytest.raises(ValueError):
            source_folder(spark, "auto", kind, path)


def test_settings_from_files():
    from mnemolake.functions.models import config_file, env_file

    assert env_file("# no\n A = 1 \nB=x=y\n=z\nword\nC=\nA=2\nD=own", {"D": "kept", "B": ""}) == {"A": "1", "B": "x=y", "C": "", "D": "kept"}
    there = {"/two/config.json", "/three/config.json"}
    assert config_file(there.__contains__, "config.json", "PLACE", ["/one", "/two", "/three"], {}) == "/two/config.json"
    assert config_file(there.__contains__, "config.json", "PLACE", ["/one"], {"PLACE": "/own.json"}) == "/own.json"
    with pytest.raises(FileNotFoundError):
        config_file(there.__contains__, "config.json", "PLACE", ["/one"], {})
