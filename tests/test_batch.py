"""The batch chain, the evaluation driver, the block index, the store's changes, the vector cache and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mnemolake import batch_queries, queries, source_queries
from mnemolake.functions import embedding
from mnemolake.operators import assets, search
from mnemolake.operators.cells import CellIndex
from mnemolake.operators.index import Index, bm25_from_blocks
from mnemolake.operators.store import Store
from mnemolake.plans import batch
from mnemolake.plans.config import config
from mnemolake.plans.engine import Engine
from mnemolake.plans.retrieve import retrieve
from mnemolake.schema import memories

from .conftest import SF, same_rows

NEW = ["retrieve_batch", "retrieve_batch_indexed", "eval_run", "index_search", "store_changes", "read_cc", "read_codex", "read_gemini", "read_markdown", "read_generic", "explain_text", "distilled_rows", "pin_texts", "asset_list", "asset_tags", "vector_cells", "embed_refused", "card_texts", "collapsed_texts", "results_by_source", "entries_as_results"]


@pytest.mark.parametrize("name", NEW)
def test_rows_equal_sql(spark, name):
    assert batch_queries and source_queries
    same_rows(spark, name)


def test_batch_equals_single_searches(spark):
    rows = memories(spark, SF).cache()
    vectors = {r.id: [float(x) for x in r.vector] for r in rows.where("id % 17 = 0").collect()}
    told = []
    for i, (qid, v) in enumerate(vectors.items()):
        profile = ("default", "writing", "debug", " FactCheck ")[i % 4]
        scopes = (None, ["c"], ["memory", "asset:3"])[i % 3]
        told.append((qid, "the of thing", ["the", "of", "thing"][: i % 3 + 1], v, profile, (3, 20, 99)[i % 3], scopes, (None, "fact", "decision")[i % 5 % 3]))
    asked = spark.createDataFrame(told, "qid long, query string, terms array<string>, vector array<double>, profile string, `limit` int, scopes array<string>, category string")
    for at, more in enumerate(({"hard_min_score": 0.0}, {"hard_min_score": 0.0, "mode": "vector"}, {"rerank": "none", "diversity": 0.2, "hard_min_score": 0.05})):
        got = {}
        for r in batch.retrieve_batch(rows, asked, **more).orderBy("qid", "position").collect():
            got.setdefault(r.qid, []).append((r.id, round(r.score, 9), r.vec_rank, r.bm25_rank))
        for qid, _, terms, v, profile, limit, scopes, category in told[at::3][:1]:
            one = retrieve(rows, v, terms, config(profile, **more), limit, scopes, category).orderBy("position").collect()
            assert got.get(qid, []) == [(r.id, round(r.score, 9), r.vec_rank, r.bm25_rank) for r in one]


def test_batch_in_blocks_skips_and_unknown_profiles(spark, monkeypatch):
    rows = memories(spark, SF)
    v = [float(x) for x in rows.first().vector]
    asked = spark.createDataFrame([(f"q{i}", "words of a query", v) for i in range(5)] + [("slight", "hi", v), ("without", "words of a query", None)], "qid string, query string, vector array<double>")
    one = sorted((r.qid, r.position, r.id) for r in batch.retrieve_batch(rows, asked, hard_min_score=0.0).collect())
    monkeypatch.setattr(batch, "BROADCAST_QUERIES", 2)
    assert one == sorted((r.qid, r.position, r.id) for r in batch.retrieve_batch(rows, asked, hard_min_score=0.0).collect())
    assert {q for q, _, _ in one} == {"q0", "q1", "q2", "q3", "q4", "without"}
    with pytest.raises(Exception, match="unknown retrieval profile"):
        batch.retrieve_batch(rows, asked.withColumn("profile", F.lit("nope"))).collect()


def test_batch_asks_the_scorer_once_a_query(spark):
    rows = memories(spark, SF)
    v = [float(x) for x in rows.first().vector]
    asked = spark.createDataFrame([(1, "a query of words", v), (2, "fail for this one", v)], "qid long, query string, vector array<double>")

    def scorer(query, texts):
        return [(i, 1.0 - i / 50) for i in range(len(texts))] if "fail" not in query else 1 / 0

    plain = {(r.qid, r.id): r.reranked for r in batch.retrieve_batch(rows, asked, hard_min_score=0.0).collect()}
    got = {(r.qid, r.id): r for r in batch.retrieve_batch(rows, asked, scorer=scorer, rerank="cross-encoder", hard_min_score=0.0).collect()}
    assert all(plain.get(k, r.reranked) == pytest.approx(r.reranked) for k, r in got.items() if k[0] == 2) and any(r.reranked > plain.get(k, 0) + 0.1 for k, r in got.items() if k[0] == 1)


def W(i):  # noqa: N802
    return f"w{chr(97 + i // 26)}{chr(97 + i % 26)}"


def test_index_equals_scan_and_skips_blocks(spark, tmp_path):
    rng = random.Random(5)
    words = [W(i) for i in range(60)]
    texts = [" ".join(rng.choices(words[: rng.choice([5, 20, 60])], k=rng.randrange(1, 90))) for _ in range(900)]
    df = spark.createDataFrame([(i, t, ("cc:1", "memory", None)[i % 3]) for i, t in enumerate(texts)] + [(900, "", "memory"), (901, None, "memory")], "id long, text string, scope string").cache()
    index = Index(spark, str(tmp_path / "i"), bucket_rows=40)
    index.add(df.where("id < 500"))
    index.add(df.where("id >= 500 and text is not null"))
    live = df.where("text is not null")
    told = lambda x: [(r.id, r["rank"], round(r.raw, 9)) for r in x.orderBy("rank").collect()]
    for query, scopes in (([W(3)], None), ([W(1), W(40), "nothing"], ["c"]), ([W(55), W(59), W(55)], None), (["nothing"], None)):
        got = told(bm25_from_blocks(index, live, query, 7, scopes))
        assert got == told(search.bm25_topk(live, query, 7, scopes)) and (scopes or bool(got) == (query != ["nothing"])), query
    left = live.where("id % 4 <> 1")
    index.sync(left.select("id", "text"), live.select("id", "text"))
    index.sync(left.select("id", "text"), live.select("id", "text"))
    for query in ([W(3), W(58)], [W(50)]):
        assert told(bm25_from_blocks(index, left, query, 7)) == told(search.bm25_topk(left, query, 7)), query
    more = left.unionByName(spark.createDataFrame([(2000 + i, f"{W(50)} {W(58)}", "memory") for i in range(3)], left.schema))
    index.sync(more.select("id", "text"), more.select("id", "text"))
    assert told(bm25_from_blocks(index, more, [W(50), W(58)], 5)) == told(search.bm25_topk(more, [W(50), W(58)], 5))
    plan = index.search(spark.createDataFrame([("q", W(50))], "qid string, term string"), 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [segment" in plan and "part#" in plan and "bucket" in plan.split("PushedFilters")[1]


def test_cells_equal_scan_and_skip(spark, tmp_path):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 9) for _ in range(6)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 1) for x in rng.choice(centres)]) for i in range(1200)] + [(2000, None), (2001, []), (2002, rows_ := [0.0] * 6), (2003, rows_)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = spark.createDataFrame([(q, rows[q][1]) for q in (0, 5, 77, 900)] + [(5000, [50.0] * 6), (5001, None)], "qid long, query array<double>")
    cells = CellIndex(spark, str(tmp_path / "c"))
    cells.build(df)
    told = lambda x: sorted((r.qid, r["rank"], r.id, round(r.distance, 9)) for r in x.collect())
    good = df.where("vector is not null and size(vector) > 0")
    for k in (1, 9):
        assert told(cells.search(df, asked, k)) == told(search.vector_topk_batch(good, asked.where("query is not null"), k))
    assert 0 < cells.read_share(df, asked, 9) < 0.5
    assert told(cells.search(df, asked, 2000)) == told(search.vector_topk_batch(good, asked.where("query is not null"), 2000))
    none = CellIndex(spark, str(tmp_path / "n"))
    none.build(df.limit(0))
    assert none.search(df, asked, 3).count() == 0


def test_refused_texts_are_cut_and_others_are_not():
    seen = []

    def embed(texts):
        seen.append(list(texts))
        if any(len(t) > 700 for t in texts):
            raise ValueError("input is too long")
        return [[float(len(t)), 1.0] for t in texts]

    got = embedding.or_parts(embed, "all-MiniLM-L6-v2")(["short", "A sentence of words. " * 60])
    assert got[0] == [5.0, 1.0] and got[1][1] == 1.0 and 100 < got[1][0] <= 700 and max(len(t) for x in seen[2:] for t in x) <= 1300
    with pytest.raises(ZeroDivisionError):
        embedding.or_parts(lambda t: 1 / 0, "m")(["x"])
    with pytest.raises(ValueError):
        embedding.or_parts(lambda t: (_ for _ in ()).throw(ValueError("too long")), "m")(["never fits"])


def test_store_rows_are_entries_of_their_own(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("same text", "cc:1"), ("same text", "cc:1"), ("other", "memory")], "text string, scope string").withColumn("vector", F.array(F.lit(1.0)).cast("array<float>"))
    s.append(rows, 5)
    s.append(rows.limit(1).withColumn("importance", F.lit(float("nan"))), 6)
    ids = [r.id for r in s.read().where("text = 'same text'").collect()]
    assert len(set(ids)) == 3 and s.read().where("importance = 0.7").count() == 4
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "s" / "rows").iterdir() if p.suffix == ".parquet"}
    before = files()
    assert s.update(ids[0], importance=0.9, text="new text") and s.update(ids[0], importance=0.8) and s.delete(ids[1]) and not s.delete(ids[1])
    assert before.items() <= files().items()
    got = {r.id: r for r in s.read().collect()}
    assert len(got) == 3 and (got[ids[0]].text, got[ids[0]].importance) == ("new text", 0.8) and got[ids[2]].importance == 0.7
    with pytest.raises(PermissionError):
        s.delete(ids[0], ["memory"])
    assert s.bulk_delete(["cc"]) == 2 and [r.text for r in s.read().collect()] == ["other"]
    s.reset()
    assert s.read().count() == 0


def _line(kind, text):
    return json.dumps({"type": kind, "message": {"content": text}, "sessionId": "abcdefgh"})


def _engine(spark, path, **more):
    made = []

    def embed(texts):
        made.append(len(texts))
        return embedding.hash_embedder(16)(texts)

    return Engine(spark, str(path), embed, 16, **more)


def test_stream_takes_new_and_changed_files_and_stands_repeats(spark, tmp_path):
    e, folder = _engine(spark, tmp_path / "e"), tmp_path / "in"
    folder.mkdir()
    long = "The harbour crane is checked by two keepers on Mondays. " * 12
    (folder / "a.jsonl").write_text("\n".join([_line("user", "How is the crane checked?"), _line("assistant", long), "broken {"]))
    told = e.stream(str(folder), "cc", str(tmp_path / "ck"), "2024-01-01")
    assert [t["files"] for t in told] == [1, 0] and told[0]["broken"] == 1 and e.store.read().count() == told[0]["chunks"] > 0
    (folder / "b.jsonl").write_text(_line("user", "And who paints the lighthouse? " * 20))
    (folder / "a.jsonl").write_text("\n".join([_line("user", "How is the crane oiled now?"), _line("assistant", long), _line("user", "A new line was added here at the end."), " " * 300]))
    told = e.stream(str(folder), "cc", str(tmp_path / "ck"), "2024-01-02")
    assert [t["files"] for t in told] == [1, 1]
    texts = [r.text for r in e.store.read().collect()]
    assert len(texts) == len(set(texts)) and not any("How is the crane checked" in t for t in texts) and any("oiled" in t for t in texts)
    # a checkpoint that is lost gives all files again: they take the place of themselves
    e.stream(str(folder), "cc", str(tmp_path / "ck2"), "2024-01-03")
    assert sorted(r.text for r in e.store.read().collect()) == sorted(texts)
    assert e.search("who paints the lighthouse", limit=1).first().text.startswith("[用户] And who paints")
    assert not (tmp_path / "e" / "rows" / "intake").exists() or not list((tmp_path / "e" / "rows" / "intake").iterdir())


def test_cache_embeds_once_until_its_age(spark, tmp_path):
    df = spark.createDataFrame([("a text",), ("a text",), ("",), (None,), ("b text",)], "text string")
    cache = lambda now: embedding.VectorCache(spark, str(tmp_path / "v"), embedding.hash_embedder(8), now, 8, 1000)
    full, n = cache(0).vectors(df)
    assert n == 3 and {r.text: len(r.vector) for r in full.collect()} == {"a text": 8, "": 0, None: 0, "b text": 8} and full.count() == 5
    assert cache(999).vectors(df)[1] == 0 and cache(1000).vectors(df)[1] == 3


def test_clean_keeps_clean_briefs(spark, tmp_path):
    e = _engine(spark, tmp_path / "e")
    rows = [(f"{i:08x}", "t", "s", "q", "p", f"2024-03-01T{i:05d}", 1, [("asset" if i in (100, 250) else "cc", 1)], [], [], [], []) for i in range(251)]
    assets.save(spark.createDataFrame(rows, assets.BRIEF), f"{e.path}/briefs")
    assert sorted(r.id for r in e.clean(remove=True).collect()) == [f"{100:08x}", f"{250:08x}"]
    assert e.briefs(1000).count() == 249 and e.clean().count() == 0 and len(list((tmp_path / "e" / "archive").glob("*.json"))) == 2
    (tmp_path / "e" / "briefs" / "99999-corrupt.json").write_text("{no")
    assert [r.id for r in e.briefs(3).collect()] == [f"{i:08x}" for i in (249, 248)] and len(assets.newest_files(spark, f"{e.path}/briefs", 3)) == 3
    assert e.get_pin("abc").count() == 0 and e.pins().count() == 0


def test_pins_repeats_cases_and_arms_that_fail(spark, tmp_path):
    e, notes = _engine(spark, tmp_path / "e", hard_min_score=0.0), tmp_path / "notes"
    notes.mkdir()
    for n in "ab":
        (notes / f"{n}.md").write_text("# Lamp\nThe lighthouse lamp is changed every spring by two keepers.")
    (notes / "c.md").write_text("# Crane\nThe crane is oiled on Mondays and checked by the harbour master.")
    told = e.ingest(str(notes), "2024-01-01")
    assert told["files"] == 3 and told["chunks"] == 3 and told["embedded"] == 2
    found = e.search("lighthouse lamp keepers", limit=5).collect()
    assert len(found) == len({r.id for r in found}) and len([r for r in found if "lamp" in r.text]) == 2
    pin = e.pin(found[0].id, "2024-02-02T00:00:00.000Z").first()
    assert pin.memory_id == found[0].id and e.store.get(found[0].id).first().importance == pytest.approx(0.95) and e.store.read().count() == 4
    (tmp_path / "cases.json").write_text(json.dumps([{"name": "lamp", "query": "lighthouse lamp keepers", "profile": "writing", "expectAny": ["Lamp"], "expectAll": ["two keepers"], "expectScopePrefixes": ["memory"]}, {"name": "none", "query": "the crane on mondays", "scope": "nowhere:1", "expectAny": ["crane"], "notes": "a note"}, {"name": "bad", "query": "the crane on mondays", "forbid": ["CRANE"]}]))
    reports = {r.name: r for r in e.evaluate(str(tmp_path / "cases.json"), "now", str(tmp_path / "r.md")).collect()}
    assert (reports["lamp"].score, reports["lamp"].passed, reports["lamp"].matched_all) == (1.0, True, ["two keepers"]) and reports["lamp"].hits >= 2
    assert (reports["none"].hits, reports["none"].score, reports["none"].top_snippet) == (0, 0.5, "-") and not reports["bad"].passed and reports["bad"].forbidden == ["CRANE"]
    assert "- Passed: 1/3" in (tmp_path / "r.md").read_text() and "- Notes: a note" in (tmp_path / "r.md").read_text()
    e.evaluate(str(tmp_path / "cases.json"), "now", str(tmp_path / "r.json"), "json")
    assert {r["name"] for r in json.loads((tmp_path / "r.json").read_text())["reports"]} == {"lamp", "none", "bad"}
    deaf = Engine(spark, e.path, lambda texts: 1 / 0, 16, hard_min_score=0.0)
    assert [r.id for r in deaf.search("crane oiled", limit=1).collect()] and any(f.startswith("embedder") for f in deaf.failures)
    broken = _engine(spark, e.path, hard_min_score=0.0)
    broken.index.search = lambda *a: 1 / 0
    assert broken.search("crane oiled", limit=2).count() and any(f.startswith("keywords") for f in broken.failures)
    assert queries.QUERIES["retrieve_batch"]
