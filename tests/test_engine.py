import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnemolake import queries
from mnemolake.functions import chunking, embedding
from mnemolake.functions import text as X
from mnemolake.operators import assets, search, turns
from mnemolake.operators.store import Store, by_prefix
from mnemolake.plans import config
from mnemolake.sources import transcripts
from mnemolake.streaming.ingest import stream_files

from .conftest import SF, same_rows

CHECKED = ("vector_topk", "bm25_topk", "hybrid_fusion", "retrieve_hybrid_writing", "mmr_diversity", "noise_filter", "skip_queries", "text_labels", "best_snippet", "pair_turns", "session_fill", "store_stats", "source_map", "dirty_briefs", "tag_counts", "profiles", "eval_scores", "ledger_new_files", "bm25_from_index", "rerank_blend", "export_files", "brief_asset", "search_rows")


@pytest.mark.parametrize("name", CHECKED)
def test_rows_equal_sql(spark, name):
    same_rows(spark, name)


def test_best_snippet_of_odd_rows_equals_sql(spark, tmp_path):
    """Texts without a sentence give no row, rows of one doc_id give one, and a mark that ends a line is no space."""
    for f in os.listdir(SF):
        if f != "documents.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    texts = [(1, None), (2, ""), (3, " \n\t\u00a0\n"), (4, "One. The thing of it."), (4, "A thing. Two."), (4, None), (5, "Same the. Same of."), (5, "Same the. Same of."), (6, "the end \u0085\nno"), (7, "..."), (None, "no id. the"), (None, "of the"), (8, "x" * 179 + "é" * 5), (9, " \n a\r\n\u2028")]
    ids, texts = zip(*texts)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    same_rows(spark, "best_snippet", str(tmp_path))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_profiles():
    assert config.resolve_profile(" FactCheck ") == "fact-check"
    assert config.config("writing").hard_min_score == 0.24
    assert config.clamp_limit(float("nan")) == 1 and config.clamp_limit(99) == 20
    with pytest.raises(ValueError):
        config.resolve_profile("nope")
    assert [config.parse_limit(x, 5) for x in (None, "", "x", "7", " 12abc", "-3", "99", "0x1")] == [5, 5, 5, 7, 12, 1, 50, 1]
    with pytest.raises(ValueError):
        config.parse_limit("many")


def test_skip_on_driver_matches_column():
    for q, skip in queries._SKIP_ROWS.items():
        assert X.should_skip(q) == skip, q


def test_skip_of_known_queries(spark):
    df = spark.createDataFrame([(q,) for q in queries._SKIP_ROWS], "q string")
    assert {r.q: r.skip for r in df.select("q", X.skips(F.col("q")).alias("skip")).collect()} == queries._SKIP_ROWS


def test_dirty_briefs_name_each_reason(spark):
    row = lambda i, summary, source, takeaway, evidence, reusable: (i, i, summary, "q", "writing", f"2024-01-0{i[1]}", 2, [(source, 2)], [takeaway], [("m1", evidence)], [reusable], ["a"])
    rows = [
        row("b1", "all fine", "cc", "cc: x", "cc", "a text"), row("b2", "fine", "asset", "cc: x", "cc", "a"), row("b3", "fine", "cc", "asset: x", "cc", "a"), row("b4", "fine", "cc", "cc: x", "asset", "a"),
        row("b5", "see [pinned asset] here", "cc", "cc: x", "cc", "a"), row("b6", "fine", "cc", "cc: x", "cc", "x [Memory Brief] y"), ("b7", "t", "fine", "q", "writing", "2024-01-07", 0, [], [], [], [], []),
    ]
    found = {r.id: r.reasons for r in assets.dirty_briefs(spark.createDataFrame(rows, assets.BRIEF)).collect()}
    assert found == {"b2": ["source includes asset"], "b3": ["takeaways include asset"], "b4": ["evidence includes asset"], "b5": ["summary contains asset marker"], "b6": ["reusable candidate contains asset marker"]}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n。", max_size=600))
def test_chunks_cover_all_but_space(text):
    cfg = chunking.ChunkConfig(60, 5, 10, 4)
    seen = set()
    for c, a, b in chunking.chunk(text, cfg):
        assert text[a:b] == c and len(c) <= cfg.size
        seen.update(range(a, b))
    assert all(i in seen or text[i].isspace() for i in range(len(text)))


def test_pairing_with_orphans(spark):
    rows = [(1, 0, "assistant", "a0"), (1, 1, "user", "u1"), (1, 2, "assistant", "a2"), (1, 3, "assistant", "a3"), (1, 4, "user", "u4"), (1, 5, "user", "u5")]
    got = turns.pair_turns(spark.createDataFrame(rows, "c int, t int, role string, text string"), "c", "t").orderBy("t").select("pair").collect()
    u, a = turns.USER, turns.ASSISTANT
    assert [r[0] for r in got] == [f"{a} a0", f"{u} u1\n\n{a} a2", f"{a} a3", f"{u} u4", f"{u} u5"]


def test_readers(spark, tmp_path):
    pad = {"type": "other", "pad": "x" * 600}
    cc = [{"type": "user", "sessionId": "s1", "timestamp": "t", "message": {"content": "a plain question"}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "part one of it"}, {"type": "tool_use"}, {"type": "text", "text": "part two"}]}}, {"type": "user", "message": {"content": "ten chars!"}}, pad]
    (tmp_path / "cc").mkdir()
    (tmp_path / "cc" / "a.jsonl").write_text("\n".join([json.dumps(cc[0]), "not json", "", *map(json.dumps, cc[1:])]))
    got = transcripts.read_cc(spark, str(tmp_path / "cc")).orderBy("seq").collect()
    assert [(r.role, r.text, r.session) for r in got] == [("user", "a plain question", "s1"), ("assistant", "part one of it\npart two", "s1")]
    cx = [{"type": "session_meta", "payload": {"id": "z9"}}, {"type": "response_item", "payload": {"role": "user", "content": [{"type": "input_text", "text": "a question here"}]}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "a question here"}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "another question"}}, {"type": "response_item", "payload": {"role": "developer", "content": [{"type": "input_text", "text": "do not show this"}]}}, {"type": "response_item", "payload": {"role": "assistant", "content": [{"type": "output_text", "text": "a sufficiently long answer"}]}}]
    (tmp_path / "cx" / "in").mkdir(parents=True)
    (tmp_path / "cx" / "in" / "b.jsonl").write_text("\n".join(map(json.dumps, cx)))
    got = transcripts.read_codex(spark, str(tmp_path / "cx")).orderBy("seq").collect()
    assert [(r.role, r.text, r.session) for r in got] == [("user", "a question here", "z9"), ("user", "another question", "z9"), ("assistant", "a sufficiently long answer", "z9")]
    gm = {"sessionId": "g1", "startTime": "t", "messages": [{"type": "info", "content": "ignored entirely"}, {"type": "user", "content": "at least ten"}, {"type": "gemini", "content": [{"text": "a"}, {"text": "b long enough"}]}, {"type": "user", "content": "ninechars"}]}
    (tmp_path / "gm").mkdir()
    (tmp_path / "gm" / "session-1.json").write_text(json.dumps(gm))
    (tmp_path / "gm" / "session-2.json").write_text("{" + "x" * 200)
    got = transcripts.read_gemini(spark, str(tmp_path / "gm")).orderBy("seq").collect()
    assert [(r.role, r.text, r.session) for r in got] == [("user", "at least ten", "g1"), ("assistant", "a\nb long enough", "g1")]
    md = spark.createDataFrame([("/n/note.md", "preamble that is longer than thirty characters\n# One\nshort\n## Two\n#### not a heading but part of the body\nmore")], "file string, content string")
    assert [(r.heading) for r in transcripts.markdown_sections(md).orderBy("section").collect()] == ["note", "Two"]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x.json").write_text(json.dumps(["a first item of text that is long", {"role": "user", "content": "a second"}]))
    assert transcripts.read_generic(spark, str(tmp_path / "g")).first()["text"] == "a first item of text that is long\n\n[user] a second"


def test_store_changes(spark, tmp_path):
    s = Store(spark, str(tmp_path / "m"), dim=2)
    rows = spark.createDataFrame([("00000000aa", "one", [1.0, 0.0], "cc:1"), ("00000000ab", "two", [0.0, 1.0], "memory")], "id string, text string, vector array<float>, scope string")
    s.append(rows, 5)
    assert s.read().count() == 2
    with pytest.raises(ValueError):
        s.get("00000000")
    with pytest.raises(PermissionError):
        s.get("00000000aa", ["memory"])
    assert s.update("00000000aa", importance=0.9) and s.get("00000000aa").first()["importance"] == 0.9
    assert s.bulk_delete(["cc"]) == 1 and s.read().count() == 1
    assert s.delete("00000000ab") and s.read().count() == 0
    with pytest.raises(ValueError):
        by_prefix(rows, "xyz")
    with pytest.raises(ValueError):
        s.bulk_delete()


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, ck = (tmp_path / n for n in ("src", "out", "ck"))
    src.mkdir()
    (src / "1.json").write_text('{"conv_id":1,"turn":0,"role":"user","text":"x"}\n')
    stream_files(spark, str(src), str(out), str(ck))
    (src / "2.json").write_text('{"conv_id":2,"turn":0,"role":"user","text":"y"}\n')
    stream_files(spark, str(src), str(out), str(ck))
    assert sorted(r[0] for r in spark.read.parquet(str(out)).select("text").collect()) == ["x", "y"]


def test_embeddings_and_cache(spark):
    df = spark.createDataFrame([("a text",), ("",), ("a text",)], "text string")
    got = {r.text: r.vector for r in embedding.with_vectors(df, embedding.hash_embedder(8)).collect()}
    assert got[""] == [] and len(got["a text"]) == 8
    cache = spark.createDataFrame([], "key string, vector array<float>")
    full, fresh = embedding.with_cached_vectors(df.where("text <> ''"), cache, embedding.hash_embedder(8))
    assert full.count() == 2 and fresh.count() == 1


def test_embed_documents_takes_every_document(spark):
    embed = embedding.hash_embedder()
    got = {r.doc_id: r.vector for r in queries.QUERIES["embed_documents"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    long = max(texts, key=lambda i: len(texts[i] or ""))
    parts = embed([c for c, _, _ in chunking.chunk(texts[long], chunking.MARKDOWN)])
    assert len(parts) > 1 and got[long] == pytest.approx([sum(x) / len(parts) for x in zip(*parts)], abs=1e-6)


def test_embeddings_of_benchmark_items(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(3)
    rows = embedding.with_vectors(items, embedding.hash_embedder(), long_texts=chunking.MARKDOWN).collect()
    assert len(rows) == 3 and all(r.vector == pytest.approx(embedding.hash_embedder()([r.text])[0], abs=1e-6) for r in rows)


def test_fanout_names_first_places(spark):
    same_rows(spark, "keyword_fanout")


def test_batch_search_takes_every_fiftieth_row(spark):
    same_rows(spark, "vector_topk_batch")
    ids = {r.qid for r in queries.QUERIES["vector_topk_batch"](spark, SF).collect()}
    assert ids == {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
    e = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    qs = e.where("id < 9").selectExpr("id AS qid", "vector AS query")
    assert sorted(search.vector_topk_blocks(e, qs, 3, 2).collect()) == sorted(search.vector_topk_batch(e, qs, 3).collect())


def test_vector_search_plan_is_take_ordered(spark):
    plan = queries.QUERIES["vector_topk"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    plan = queries.QUERIES["scope_filter"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint" in plan and "text" not in plan.split("ReadSchema")[1][:60]


def test_utf16_length(spark):
    assert spark.range(1).select(X.utf16_length(F.lit("a😀"))).first()[0] == 3
