"""Registered queries of reranking, stored postings, views, assets, exports, the ledger and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .operators import assets, evaluation, exports, rerank, search, tracker
from .plans import views
from .queries import TERMS, memories, query, table
from .schema import shared_folder

WORDS, PROFILE, CREATED = "the of thing", "writing", "2024-02-01T10:20:30.123Z"


@query("bm25_from_index", Q.SQL["bm25_topk"])
def bm25_from_index(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("global").alias("scope"))
    path = shared_folder(spark, "index")
    search.write_index(docs, path)
    return search.bm25_from_index(path, docs.select("id", "scope"), TERMS, 20).select("id", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"), "rank")


@query("rerank_blend", f"WITH dm AS (SELECT doc_id AS id, text FROM documents), {Q._bm25_sql('dm', TERMS, 20)} SELECT id, round(CASE WHEN id % 3 = 0 THEN 0.8 * score ELSE least(1, greatest(0, 0.6 * ((id % 10) / 10.0::DOUBLE) + 0.4 * score)) END, 6) AS reranked FROM bk")
def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("global").alias("scope"))
    found = search.bm25_topk(docs, TERMS, 20).select("id", F.col("score").alias("fused"), (F.col("rank") - 1).alias("position"))
    scores = found.where("id % 3 <> 0").select("position", (F.col("id") % 10 / 10.0).alias("cross"))
    return rerank.blended(found, scores).select("id", F.round("reranked", 6).alias("reranked"))


_DATE = "strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d')"
_PERCENT = "CAST(CAST(round(score * 100) AS INTEGER) AS VARCHAR) || '%'"
_CELL = "rpad({0}, CAST(greatest({1}, length({0})) AS INTEGER), ' ')"
_SHORT = Q._CLIP.format(Q._collapse_sql("snippet"), 120)


@query("search_rows", f"{Q._RES} SELECT rank AS position, concat_ws(' ', {_CELL.format('CAST(rank AS VARCHAR)', 2)}, {_CELL.format('CAST(id AS VARCHAR)', 8)}, {_CELL.format(_PERCENT, 5)}, {_CELL.format('source', 7)}, {_DATE}, {_CELL.format(chr(39) + 'vector' + chr(39), 20)}, file, '|', {_SHORT}) AS line FROM r")
def search_rows(spark: SparkSession, d: str) -> DataFrame:
    return views.search_rows(Q._rows(spark, d), F.lit("vector"))


@query("projected_rows", f"{Q._RES} SELECT rank AS position, CAST(id AS VARCHAR) AS id, scope, source, {_DATE} AS date, file, round(score, 6) AS score, 'vector' AS retrieval_path, snippet FROM r")
def projected_rows(spark: SparkSession, d: str) -> DataFrame:
    return views.projected(Q._rows(spark, d), F.lit("vector"))


@query("brief_asset", f"""{Q._RES}, t AS (SELECT source || ': ' || snippet AS takeaway, trim(snippet) AS plain, min(rank) AS p FROM r GROUP BY ALL ORDER BY p LIMIT 4), j AS (SELECT string_agg(plain, ' ' ORDER BY p) AS s, string_agg(takeaway, chr(10) ORDER BY p) AS t FROM t)
SELECT '{WORDS} brief' AS title, {Q._CLIP.format(Q._collapse_sql("s"), 260)} AS summary, t AS takeaways, CAST((SELECT count(*) FROM r) AS INTEGER) AS hits, (SELECT string_agg(source || '(' || n || ')', ',' ORDER BY n DESC, p) FROM (SELECT source, count(*) AS n, min(rank) AS p FROM r GROUP BY source)) AS sources FROM j""")
def brief_asset(spark: SparkSession, d: str) -> DataFrame:
    rows = Q._rows(spark, d).withColumn("vec_rank", F.col("rank")).withColumn("bm25_rank", F.lit(None).cast("long"))
    made = assets.build_briefs(views.distilled(rows, WORDS, PROFILE, F.lit("vector")), CREATED)
    return made.select("title", "summary", F.array_join("takeaways", "\n").alias("takeaways"), "hits", F.array_join(F.transform("sources", lambda s: F.concat(s["source"], F.lit("("), s["hits"].cast("string"), F.lit(")"))), ",").alias("sources"))


@query("asset_rows", f"WITH {Q.MEMORIES_SQL} SELECT 'asset:' || substr(sha256('pin:' || id), 1, 8) AS scope, 'decision' AS category, 0.96::DOUBLE AS importance, 'pinned-memory' AS kind, CAST(id AS VARCHAR) AS original, scope AS original_scope FROM mem")
def asset_rows(spark: SparkSession, d: str) -> DataFrame:
    made = assets.build_pins(memories(spark, d), CREATED)
    rows = assets.memory_rows(made.withColumn("text", assets.pin_text(F.col("title"), F.col("summary"), F.col("snippet"), F.col("original_scope"), F.col("tags"))), "pinned-memory")
    field = lambda name: F.get_json_object("metadata", f"$.{name}")
    return rows.select("scope", "category", "importance", field("assetType").alias("kind"), field("originalMemoryId").alias("original"), field("originalScope").alias("original_scope"))


_ITEM = f"concat_ws(chr(10), '### ' || rank || '. ' || substr({Q._collapse_sql('text')}, 1, 72), '', '- Memory ID: ' || id, '- Scope: ' || scope, '- Score: ' || {_PERCENT}, '- File: ' || file, '- Date: ' || strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S') || '.000Z', '- Retrieval: vector', '', text, '')"


@query("export_files", f"{Q._RES} SELECT '2024-02-01T10-20-30-the-of-thing.md' AS file, concat_ws(chr(10), '# Memory Export', '', '- Query: {WORDS}', '- Profile: {PROFILE}', '- Created: {CREATED}', '- Hits: ' || count(*), '', '## Distilled Brief', '', 'told', '', '## Evidence', '', string_agg({_ITEM}, chr(10) ORDER BY rank)) AS content FROM r")
def export_files(spark: SparkSession, d: str) -> DataFrame:
    found = Q._results(spark, d).withColumn("path", F.lit("vector"))
    return exports.build_exports(found.select("position", "id", "scope", "score", "timestamp_ms", "text", "metadata", "path", F.lit(WORDS).alias("query"), F.lit(PROFILE).alias("profile"), F.lit(CREATED).alias("created_at"), F.lit("told").alias("summary")))


@query("export_list", f"SELECT '2024-02-01T10-20-30-the-of-thing' AS id, '{WORDS}' AS query, '{PROFILE}' AS profile, '{CREATED}' AS created_at, 'md' AS format, 'told' || chr(10) || chr(10) || '## Evidence' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY i) AS summary FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i, unnest(string_split(item, chr(10))[1:6]) AS line FROM ({Q._RES} SELECT {_ITEM} AS item FROM r WHERE rank = 1))")
def export_list(spark: SparkSession, d: str) -> DataFrame:
    return exports.parse_exports(export_files(spark, d).withColumn("modified", F.lit("2024-03-01").cast("timestamp"))).drop("file")


@query("tracker_stats", "SELECT count(*) AS files, CAST(sum(CASE WHEN page_id % 3 > 0 THEN page_id % 7 ELSE page_id % 5 END) AS BIGINT) AS chunks FROM pages")
def tracker_stats(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("path"), F.length("html").cast("long").alias("size"), F.lit(1.0).alias("mtime_ms"))
    ledger = p.where("page_id % 3 < 2").withColumn("chunks", F.col("page_id") % 5).withColumn("ingested_at", F.lit("2024-01-01")).drop("page_id")
    return tracker.stats(tracker.mark(ledger, p.where("page_id % 3 > 0").withColumn("chunks", F.col("page_id") % 7).drop("page_id"), "2024-02-01"))


@query("eval_totals", f"SELECT count(*) AS cases, count_if(passed)::BIGINT AS passed, round(avg(score), 6) AS average FROM ({Q.SQL['eval_scores']})")
def eval_totals(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.totals(Q.eval_scores(spark, d))
