"""Cases that findings of reviews named."""

import os
import random

import pyarrow as pa

from mnemolake.functions import arrow, embedding
from mnemolake.llm import labelled, quality, toxicity
from mnemolake.operators import search
from mnemolake.operators.cells import CellIndex
from mnemolake.operators.index import FEW, Index
from mnemolake.plans import batch

from .conftest import SF, same_rows


def _tables(spark, folder, **changed) -> str:
    """The smallest tables with some of them replaced."""
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        changed.get(t, spark.read.parquet(f"{SF}/{t}.parquet")).coalesce(1).write.parquet(f"{folder}/{t}")
        [part] = [f for f in os.listdir(f"{folder}/{t}") if f.startswith("part-")]
        os.rename(f"{folder}/{t}/{part}", f"{folder}/{t}.parquet")
    return str(folder)


def test_ledger_of_pages_that_share_a_url(spark, tmp_path):
    rows = [(i, f"http://a/{i % 4}", "x" * (5 + i % 2)) for i in range(60)]
    same_rows(spark, "ledger_new_files", _tables(spark, tmp_path, pages=spark.createDataFrame(rows, "page_id long, url string, html string")))


def test_generic_files_of_just_enough_characters(spark, tmp_path):
    texts = [t for n in range(9, 16) for t in ("a" * n, "\n" + "b" * (n - 1), '"\\' + "c" * (n - 2))] + ["d" * n for n in range(47, 53)]
    rows = [(2 * i + odd, t, "en", "src18", len(t)) for odd in (0, 1) for i, t in enumerate(texts)]
    same_rows(spark, "read_generic", _tables(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")))


def test_arms_of_a_batch_meet_no_row_with_every_query(spark):
    """The arms equal plain sums, also beside rows without a vector, and score in blocks, not by a join of all queries with all rows."""
    v = lambda i: [float((i * 7 + j * 3) % 11) for j in range(4)]
    scopes = ("cc:1", None, "asset:3")
    rows = [(i, f"w{'abcdef'[i % 6]} w{'abcdef'[i % 4]} common", v(i), scopes[i % 3]) for i in range(120)] + [(500, "wa", [], "cc:1"), (501, "", None, "cc:1")]
    df = spark.createDataFrame(rows, "id long, text string, vector array<double>, scope string").repartition(5)
    takes = ([], ["c"], ["asset:3", "glob"])
    told = [(f"q{i}", [x + 0.5 for x in v(i)], takes[i % 3], "hybrid", 7, ["wa", "common", "nothing"][: i % 3 + 1]) for i in range(9)]
    asked = spark.createDataFrame(told, "qid string, asked array<double>, scopes array<string>, mode string, pool int, terms array<string>")
    near = batch.vector_arm(df, asked)
    got = {}
    for r in near.orderBy("qid", "vec_rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.vec_rank))
    for qid, q, s, *_ in told:
        own = [(sum((a - b) ** 2 for a, b in zip(x, q)), i) for i, _, x, sc in rows if x and (not s or any((sc or "global") == y if ":" in y else (sc or "global").startswith(y) for y in s))]
        assert got.get(qid, []) == [(i, n + 1) for n, (d, i) in enumerate(sorted(own)[:7]) if 1 / (1 + d) >= 0.1]
    words = batch.keyword_arm(df, asked)
    for qid, *_, terms in told:
        want = search.bm25_topk(df, terms, 20).orderBy("rank").collect()
        assert [(r.id, round(r.raw, 9)) for r in words.where(words.qid == qid).orderBy("place").collect()] == [(r.id, round(r.raw, 9)) for r in want]
    plans = [x._jdf.queryExecution().toString() for x in (near, words)]
    assert not any("NestedLoop" in p or "Cartesian" in p or "array_contains" in p for p in plans)


def test_index_scores_many_queries_together(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{a}{b}" for a in "abcdefg" for b in "abcdefg"]
    rows = [(f"r{i:03}", " ".join(rng.choices(words[: rng.choice([6, 49])], k=rng.randrange(1, 40)))) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, text string").cache()
    index = Index(spark, str(tmp_path / "i"), bucket_rows=32)
    index.add(df)
    asked = spark.createDataFrame([(q, t) for q in range(FEW + 9) for t in {words[q], words[q % 3], "nothing"}], "qid int, term string")

    def told(x):
        return sorted((r.qid, r.place, r.id, round(r.raw, 9)) for r in x.collect())

    for left in (df, df.where("substr(id, 4) <> '7'")):
        index.sync(left, df)
        many = index.search(asked, 5)
        assert "MapInArrow" in many._jdf.queryExecution().toString()
        assert told(many) == told(index.search(asked.where("qid < 9"), 5).unionByName(index.search(asked.where("qid >= 9 and qid < 20"), 5)).unionByName(index.search(asked.where("qid >= 20"), 5)))


def test_counts_of_postings_take_no_shuffle(spark):
    df = spark.createDataFrame([(1, "b a b a b"), (2, ""), (3, None), (4, "x")], "id long, text string")
    found = search.postings(df)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 2, 5), ("b", 1, 3, 5), ("x", 4, 1, 1)]
    assert "Exchange" not in found._jdf.queryExecution().toString()


def test_cells_join_no_queries_with_rows(spark, tmp_path):
    """Equal to a scan where many rows are one vector, in blocks of queries, without a join of pairs."""
    rng = random.Random(6)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = spark.createDataFrame([(i, v) for i, v in rows[::20]], "qid long, query array<double>")
    cells = CellIndex(spark, str(tmp_path / "c"))
    cells.build(df)
    found = cells.search(df, asked, 6)
    told = lambda x: sorted((r.qid, r["rank"], r.id, round(r.distance, 9)) for r in x.collect())
    assert told(found) == told(search.vector_topk_batch(df, asked, 6))
    assert "Join" not in found._jdf.queryExecution().toString()


def test_embedder_sees_few_texts_at_a_time(spark):
    """Python holds the vectors of a few rows, whatever the size of the session's batches."""
    before = {k: spark.conf.get(k) for k in arrow.BATCH}
    for k in before:
        spark.conf.unset(k)
    made = embedding.with_vectors(spark.range(3000).selectExpr("id", "concat('a text of row ', id) text"), embedding.hash_embedder(8))
    assert all(int(spark.conf.get(k)) <= most for k, most in arrow.BATCH.items())
    assert made.where("size(vector) = 8").select("id").distinct().count() == 3000
    assert [p.num_rows for p in arrow.slices(pa.RecordBatch.from_arrays([pa.array(range(600))], ["x"]))] == [256, 256, 88]


def test_fits_take_no_sample_to_the_driver(spark, monkeypatch):
    """The classifiers are fitted in a task on the same rows in the same order; only the models come to the driver."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = [r.text for r in docs.select("text").collect()]
    plain = lambda cols, *a: sorted(((r.doc_id, r.text or "", *[r[c] for c in cols]) for r in labelled.training_sample(docs, labels, *a).collect()))
    q = quality.QualityModel([(t, n, y) for _, t, n, y in plain(["n_chars", "y"], "quality", quality.MODULUS, quality.HELD_OUT)])
    t = toxicity.ToxicityModel([(t, y) for _, t, y in plain(["y"], "toxic", toxicity.MODULUS, toxicity.HELD_OUT, toxicity.FIT_DOCS)])

    def refused(*_):
        raise AssertionError("fitted on the driver")

    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(type(docs), name, refused)
    found = quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels)
    assert found[0].score(texts, [None] * len(texts)) == q.score(texts, [None] * len(texts))
    assert found[1].score(texts) == t.score(texts)
    assert labelled.fitted(docs.select("text", "doc_id"), lambda rows: os.getpid()) != os.getpid()
