"""Registered queries of the batch chain, the evaluation driver, the block index and changes of the store, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .functions import embedding
from .functions import scoring as S
from .operators import evaluation
from .operators.cells import CellIndex
from .operators.index import Index
from .operators.search import tokens
from .operators.store import Store
from .plans.batch import retrieve_batch
from .plans.config import ARM_LIMIT, ARM_MIN_SCORE, PROFILES, SHIPPED, config
from .queries import memories, query, table
from .schema import DAY_MS, MEMORIES_SQL, NOW_MS, shared_folder

NAMES = list(PROFILES)
#: Every so many rows is a query of the batch, by its vector and its first words.
EVERY, WORDS, LIMIT = 50, 5, 6


def _asked(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("id") / EVERY).cast("long")
    words = F.array_distinct(F.slice(tokens(F.col("text")), 1, WORDS))
    profile = F.element_at(F.array(*map(F.lit, NAMES)), (n % len(NAMES) + 1).cast("int"))
    scopes = F.when(n % 2 == 1, F.array(F.lit("c"), F.lit("memory"), F.lit("asset:3"))).otherwise(F.array().cast("array<string>"))
    return memories(spark, d).where(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), F.concat(F.lit("about "), F.array_join(words, " ")).alias("query"), words.alias("terms"), "vector", profile.alias("profile"), scopes.alias("scopes"), F.lit(LIMIT).alias("limit"))


def _batch_sql(cutoff: float | None) -> str:
    """qid, id, score, position and columns of the rows, as `r`."""
    cfg = ", ".join(f"('{p}', {c.recency_days}::DOUBLE, {c.recency_weight}::DOUBLE, {c.decay_days}::DOUBLE, {c.length_anchor}::DOUBLE, {c.hard_min_score if cutoff is None else cutoff}::DOUBLE, {c.candidate_pool_size})" for p, c in ((p, config(p)) for p in NAMES))
    one = lambda e: f"least(1.0, greatest(0.0, {e}))"
    age = f"({NOW_MS} - timestamp_ms) / {DAY_MS}.0"
    factor = "CASE WHEN starts_with(scope, 'asset:brief:') THEN 0.88 WHEN starts_with(scope, 'asset:') THEN 1.04 END"
    fits = "(len(scopes) = 0 OR len(list_filter(scopes, lambda s: CASE WHEN contains(s, ':') THEN scope = s ELSE starts_with(scope, s) END)) > 0)"
    back = ", ".join(f"round({c}, 9) DESC" for c in ("decay", "len", "asset", "imp", "recency", "rr", "fused")) + ", ord"
    near = f"len(list_filter(m.sel, lambda s: {Q._COS.format('s', 'k.v')} > {SHIPPED.diversity}::DOUBLE)) > 0"
    gain = f"ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {S.K1 + 1} / (tf + {S.K1} * (1 - {S.B} + {S.B} * dl / a))"
    return f"""{MEMORIES_SQL},
cfg(profile, rd, rw, dd, la, hard, cps) AS (VALUES {cfg}),
q AS MATERIALIZED (SELECT m.id AS qid, m.v AS qv, list_distinct(list_slice({Q._TOKENS.replace('text', 'm.text')}, 1, {WORDS})) AS terms, cfg.*, CASE WHEN (m.id // {EVERY}) % 2 = 1 THEN ['c', 'memory', 'asset:3'] ELSE [] END AS scopes, least({ARM_LIMIT}, greatest(cps, {2 * LIMIT})) AS pool
 FROM mem m JOIN cfg ON cfg.profile = list_extract({NAMES}, CAST((m.id // {EVERY}) % {len(NAMES)} + 1 AS INTEGER)) WHERE m.id % {EVERY} = 0),
vd AS (SELECT qid, pool, mem.id, {Q._DIST.format("v", "qv")} AS d FROM mem, q WHERE {fits}),
vk AS (SELECT qid, id, 1 / (1 + d) AS vs, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS vr, pool FROM vd QUALIFY vr <= pool),
tk AS (SELECT id, {Q._TOKENS} AS t FROM mem),
h AS MATERIALIZED (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY ALL),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS a FROM tk),
f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
bm AS (SELECT qid, id, sum({gain}) AS raw FROM (SELECT qid, unnest(terms) AS term FROM q) JOIN h USING (term) JOIN f USING (term), st GROUP BY qid, id),
bl AS (SELECT bm.*, pool, scopes, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, id) AS place FROM bm JOIN q USING (qid) QUALIFY place <= pool),
bk AS (SELECT qid, bl.id, 1 / (1 + exp(-raw / 5)) AS bs, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, bl.id) AS br FROM bl JOIN mem USING (id) WHERE {fits}),
fu AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, vr, br, CASE WHEN a.id IS NOT NULL THEN least(1, vs + CASE WHEN b.id IS NOT NULL THEN 0.15 ELSE 0 END * vs) ELSE bs END AS fused, coalesce(vr, 1000 + br) AS ord
 FROM (SELECT * FROM vk WHERE vs >= {ARM_MIN_SCORE['hybrid']}) a FULL OUTER JOIN bk b ON a.qid = b.qid AND a.id = b.id),
p AS (SELECT * FROM fu WHERE fused >= {SHIPPED.min_score}::DOUBLE QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, ord) <= {2 * LIMIT}),
s0 AS (SELECT p.*, mem.* EXCLUDE (id), q.rd, q.rw, q.dd, q.la, q.hard, least(1, greatest(0, 0.7::DOUBLE * fused + 0.3::DOUBLE * ({Q._COS.format('v', 'qv')}))) AS rr FROM p JOIN mem USING (id) JOIN q USING (qid)),
s1 AS (SELECT *, {one(f"rr + exp(-{age} / rd) * rw")} AS recency FROM s0),
s2 AS (SELECT *, {one("recency * (0.7::DOUBLE + 0.3::DOUBLE * importance)")} AS imp FROM s1),
s3 AS (SELECT *, CASE WHEN starts_with(scope, 'asset:') THEN {one(f"imp * ({factor})::DOUBLE")} ELSE imp END AS asset FROM s2),
s4 AS (SELECT *, {one("asset / (1 + 0.5::DOUBLE * log2(greatest(length(text) / la, 1)))")} AS len FROM s3),
s5 AS (SELECT *, {one(f"len * (0.5::DOUBLE + 0.5::DOUBLE * exp(-{age} / dd))")} AS decay FROM s4),
kept AS (SELECT * FROM s5 WHERE decay >= hard AND NOT {Q._noise_sql('text')}),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {back}) AS r FROM kept),
m(qid, r, sel, late) AS (SELECT qid, CAST(0 AS BIGINT), CAST([] AS DOUBLE[][]), 0 FROM q UNION ALL SELECT k.qid, k.r, CASE WHEN {near} THEN m.sel ELSE list_append(m.sel, k.v) END, CASE WHEN {near} THEN 1 ELSE 0 END FROM m JOIN k ON k.qid = m.qid AND k.r = m.r + 1),
r AS (SELECT k.*, row_number() OVER (PARTITION BY k.qid ORDER BY m.late, k.r) AS position FROM k JOIN m ON k.qid = m.qid AND k.r = m.r QUALIFY position <= {LIMIT})"""


def _retrieved(spark: SparkSession, d: str, **more) -> DataFrame:
    return retrieve_batch(memories(spark, d), _asked(spark, d), **more)


@query("retrieve_batch", f"WITH RECURSIVE {_batch_sql(None)} SELECT qid, id, round(decay, 6) AS score, vr AS vec_rank, br AS bm25_rank, position FROM r")
def retrieve_batch_query(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(spark, d).select("qid", "id", F.round("score", 6).alias("score"), "vec_rank", "bm25_rank", "position")


@query("retrieve_batch_indexed", f"WITH RECURSIVE {_batch_sql(0.0)} SELECT qid, id, round(decay, 6) AS score, vr AS vec_rank, br AS bm25_rank, position FROM r")
def retrieve_batch_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The chain with no hard cutoff, its keywords from a stored index."""
    index = Index(spark, shared_folder(spark, "blocks"), bucket_rows=64)
    index.add(memories(spark, d).select("id", "text"))
    return _retrieved(spark, d, index=index, hard_min_score=0.0).select("qid", "id", F.round("score", 6).alias("score"), "vec_rank", "bm25_rank", "position")


def _cases(asked: DataFrame) -> DataFrame:
    name = F.col("qid").cast("string").alias("name")
    return asked.select(name, "query", "profile", F.slice("terms", 1, 2).alias("expect_any"), F.slice("terms", 3, 2).alias("expect_all"), F.col("scopes").alias("expect_scopes"), F.when(F.col("qid") % 3 == 0, F.slice("terms", 1, 1)).otherwise(F.array().cast("array<string>")).alias("forbid"))


_MET = "list_filter({0}, lambda t: contains(coalesce(joined, ''), lower(t)))"
_SHARE = "CASE WHEN len({1}) > 0 THEN len({0}) / len({1}) * {2} ELSE {2} END"


@query("eval_run", f"""WITH RECURSIVE {_batch_sql(0.0)},
j AS (SELECT qid, string_agg(lower(concat_ws(chr(10), scope, text, meta)), chr(10) ORDER BY position) AS joined, list(scope ORDER BY position) AS found, count(*) AS hits FROM (SELECT *, CASE WHEN source = 'asset' THEN '{{"source":"asset","assetType":"' || CASE WHEN starts_with(scope, 'asset:brief:') THEN 'memory-brief' ELSE 'pinned-memory' END || '"}}' ELSE '{{"source":"' || source || '","file":"' || file || '","heading":"' || heading || '"}}' END AS meta FROM r) GROUP BY qid),
fw AS (SELECT qid, qlist, scopes FROM (SELECT q.*, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_slice(t, 1, {WORDS}), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END) AS qlist FROM q JOIN tk ON tk.id = q.qid)),
c AS (SELECT fw.qid, list_slice(qlist, 1, 2) AS ea, list_slice(qlist, 3, 4) AS el, scopes AS es, CASE WHEN fw.qid % 3 = 0 THEN list_slice(qlist, 1, 1) ELSE [] END AS fo, joined, found, coalesce(hits, 0) AS hits FROM fw LEFT JOIN j USING (qid)),
e AS (SELECT *, {_MET.format('ea')} AS ma, {_MET.format('el')} AS ml, list_filter(es, lambda p: len(list_filter(coalesce(found, []), lambda s: starts_with(s, p))) > 0) AS ms, {_MET.format('fo')} AS bad FROM c),
z AS (SELECT *, {_SHARE.format('ma', 'ea', 0.4)} + {_SHARE.format('ml', 'el', 0.3)} + {_SHARE.format('ms', 'es', 0.2)} + CASE WHEN hits > 0 THEN 0.1 ELSE 0 END - CASE WHEN len(bad) > 0 THEN 0.3 ELSE 0 END AS s FROM e)
SELECT CAST(qid AS VARCHAR) AS name, CAST(round(least(1, greatest(0, s)), 6) AS DOUBLE) AS score, round(s, 9) >= 0.7 AND len(bad) = 0 AS passed, hits, array_to_string(ma, ',') AS matched_any, array_to_string(ms, ',') AS matched_scopes, array_to_string(bad, ',') AS forbidden, coalesce(array_to_string(list_slice(found, 1, 5), ','), '') AS top_scopes FROM z""")
def eval_run(spark: SparkSession, d: str) -> DataFrame:
    """Cases made of the queries' own rows, run and scored as one plan."""
    found = _retrieved(spark, d, hard_min_score=0.0).select(F.col("qid").cast("string").alias("name"), "position", "scope", "text", "metadata")
    told = evaluation.case_reports(_cases(_asked(spark, d)), found)
    return told.select("name", "score", "passed", "hits", *(F.array_join(c, ",").alias(c) for c in ("matched_any", "matched_scopes", "forbidden", "top_scopes")))


@query("index_search", f"""WITH tk AS (SELECT doc_id AS id, {Q._TOKENS} AS t FROM documents), h AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY ALL),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS a FROM tk), f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
q AS (SELECT DISTINCT item_id AS qid, unnest(list_slice({Q._TOKENS}, 1, 4)) AS term FROM benchmark),
bm AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {S.K1 + 1} / (tf + {S.K1} * (1 - {S.B} + {S.B} * dl / a))) AS raw FROM q JOIN h USING (term) JOIN f USING (term), st GROUP BY qid, id)
SELECT qid, id, round(raw, 6) AS raw, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, id) AS place FROM bm QUALIFY place <= 10""")
def index_search(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark items' first words, searched in an index of all documents that came in two parts."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    index = Index(spark, shared_folder(spark, "blocks"), bucket_rows=256)
    for part in (0, 1):
        index.add(docs.where(F.col("id") % 2 == part))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.slice(tokens(F.col("text")), 1, 4)).alias("term"))
    return index.search(asked, 10).select("qid", "id", F.round("raw", 6).alias("raw"), "place")


@query("store_changes", f"""WITH {MEMORIES_SQL}, a AS (SELECT text, scope, importance, timestamp_ms FROM mem UNION ALL SELECT text, scope, importance, timestamp_ms FROM mem WHERE id % 10 = 0)
SELECT md5(text) AS text, scope, count(*) AS n, count(*) AS ids, CAST(max(importance) AS DOUBLE) AS importance FROM a WHERE NOT (starts_with(scope, 'codex') AND timestamp_ms < {NOW_MS - 60 * DAY_MS}) GROUP BY md5(text), scope""")
def store_changes(spark: SparkSession, d: str) -> DataFrame:
    """A store that took all rows, a tenth of them again as entries of their own, and lost old ones of a scope."""
    store = Store(spark, shared_folder(spark, "store"))
    rows = memories(spark, d).drop("id")
    store.append(rows, NOW_MS)
    store.append(memories(spark, d).where("id % 10 = 0").drop("id"), NOW_MS)
    store.bulk_delete(["codex"], NOW_MS - 60 * DAY_MS)
    left = store.read()
    return left.groupBy(F.md5(F.col("text").cast("binary")).alias("text"), "scope").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.max("importance").alias("importance"))


@query("vector_cells", Q.SQL["vector_topk_batch"])
def vector_cells(spark: SparkSession, d: str) -> DataFrame:
    """The batch search by trained cells."""
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    cells = CellIndex(spark, shared_folder(spark, "cells"))
    cells.build(rows)
    asked = e.where(F.col("vec_id") % Q.BATCH_EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    return cells.search(rows, asked, 10).select("qid", "id", F.round("distance", 6).alias("distance"), "rank")


#: Characters beyond which the embedder of a query refuses a text, and components that it gives.
REFUSES, SIZE = 4000, 16


def _refusing(texts: list[str]) -> list[list[float]]:
    if any(len(t) > REFUSES for t in texts):
        raise ValueError("maximum context length exceeded")
    return embedding.hash_embedder(SIZE)(texts)


@query("embed_refused", f"SELECT doc_id, length(text) > {REFUSES} AS cut, CAST(CASE WHEN trim(text) <> '' THEN {SIZE} ELSE 0 END AS INTEGER) AS size, CASE WHEN trim(text) = '' THEN 'none' WHEN length(text) > {REFUSES} THEN 'shorter' ELSE 'unit' END AS norm FROM documents")
def embed_refused(spark: SparkSession, d: str) -> DataFrame:
    """Documents embedded by one that refuses long texts: these are cut and averaged, which makes their vectors shorter than one."""
    rows = embedding.with_vectors(table(spark, d, "documents").select("doc_id", "text"), embedding.or_parts(_refusing, "gemini-embedding-001"), dim=SIZE)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.select("doc_id", (F.length("text") > REFUSES).alias("cut"), F.size("vector").alias("size"), F.when(F.size("vector") == 0, "none").when(norm < 1 - 1e-5, "shorter").otherwise("unit").alias("norm"))
