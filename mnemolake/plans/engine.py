"""The engine as one object: a store with its embedder, searches by profile, assets and exports."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.embedding import Embedder, VectorCache, with_vectors
from ..operators import assets, evaluation, exports, rerank, search, summary
from ..operators.index import Index, bm25_from_blocks
from ..operators.store import Store
from ..schema import NOW_MS
from . import views
from .batch import retrieve_batch
from .config import config, resolve_profile
from .ingest import ingest, source_folder, stream_ingest
from .retrieve import reduce_paths, retrieve


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


class Engine:
    """Everything that one store at `path` is asked for. What is costly is made once, when it is first asked for."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, dim: int | None = None, scorer: rerank.Scorer | None = None, now_ms: int = NOW_MS, max_age_ms: int | None = None, **overrides):
        if not path.strip() or path.rstrip("/") in ("", "."):
            raise ValueError(f"not a place to store rows: {path!r}")
        self.spark, self.path, self.embedder, self.dim, self.scorer, self.now_ms, self.overrides = spark, path.rstrip("/"), embedder, dim, scorer, now_ms, overrides
        self.max_age_ms = max_age_ms
        self.configs: dict = {}
        self.failures: list[str] = []  # of arms that searches went on without

    @cached_property
    def store(self) -> Store:
        return Store(self.spark, f"{self.path}/rows", self.dim)

    def config(self, profile: str | None):
        name = resolve_profile(profile)
        if name not in self.configs:
            self.configs[name] = config(name, **self.overrides)
        return self.configs[name]

    @cached_property
    def cache(self) -> VectorCache:
        return VectorCache(self.spark, f"{self.path}/vectors", self.embedder, self.now_ms, self.dim, self.max_age_ms)

    @cached_property
    def index(self) -> Index:
        return Index(self.spark, f"{self.path}/index")

    def ingest(self, folder: str, now: str, kind: str | None = None) -> dict:
        """Takes in the new and changed files of a folder ("auto": see source_folder) and brings the index up to date; totals."""
        told = ingest(self.spark, source_folder(self.spark, folder, kind), self.store, self.cache, self.now_ms, now, kind)
        self.refresh()
        return told

    def stream(self, folder: str, kind: str, checkpoint: str, now: str) -> list[dict]:
        told = stream_ingest(self.spark, folder, kind, self.store, self.cache, checkpoint, self.now_ms, now)
        self.refresh()
        return told

    def refresh(self) -> None:
        """Brings the index to what is stored; it knows entries by their versions."""
        versions = lambda df: df.select(F.col("row").alias("id"), "text")
        self.index.sync(versions(self.store.live()), versions(self.store.versions()))

    def _keywords(self, df: DataFrame, query: list[str], k: int, scopes: list[str] | None = None) -> DataFrame:
        """Keyword results by the index, by a scan where there is none, and none at all where they fail: the search goes on without."""
        try:
            return bm25_from_blocks(self.index, df, query, k, scopes, "row") if self.index.exists() else search.bm25_topk(df, query, k, scopes)
        except Exception as e:
            self.failures.append(f"keywords: {e}")
            return search.bm25_topk(df.limit(0), query, k)

    def search(self, query: str, profile: str | None = None, limit: int = 5, **filters) -> DataFrame:
        """Labelled results in order of position; no row for queries too slight to look anything up."""
        if X.should_skip(query):
            return summary.labelled(retrieve(self.store.live().limit(0), None, ["empty"], self.config(profile), limit, now_ms=self.now_ms), [])
        found = retrieve(self.store.live(), self._vector(query), query_terms(query), self.config(profile), limit, now_ms=self.now_ms, query_text=query, scorer=self.scorer, keywords=self._keywords, **filters)
        return summary.labelled(found, query_terms(query))

    def _vector(self, query: str) -> list[float] | None:
        """The query's vector; where the embedder fails there is none, and the search goes by keywords."""
        try:
            return self.embedder([query])[0]
        except Exception as e:
            self.failures.append(f"embedder: {e}")
            return None

    def search_all(self, queries: DataFrame) -> DataFrame:
        """The results of a table of queries (qid, query; profile, limit, scopes, category) by one plan, with qid."""
        asked = with_vectors(queries, self.embedder, "query", dim=self.dim)
        rows = self.store.live()
        found = retrieve_batch(rows.drop("id").withColumnRenamed("row", "id"), asked, self.now_ms, self.index if self.index.exists() else None, self.scorer, **self.overrides)
        named = found.withColumnRenamed("id", "row").join(rows.select("row", "id"), "row").drop("row")
        return summary.labelled(named, [])

    def evaluate(self, cases: str, generated: str, output: str | None = None, kind: str = "md") -> DataFrame:
        """Runs the cases of a JSON file as one plan and scores them; the reports, also written to `output` as text or JSON if it is named."""
        told = evaluation.read_cases(self.spark, cases)
        scopes = F.when(F.coalesce("scope", F.lit("")) != "", F.array("scope"))
        found = self.search_all(told.select(F.col("name").alias("qid"), "query", "profile", "limit", scopes.alias("scopes")))
        results = found.select(F.col("qid").alias("name"), "position", "scope", "text", "metadata")
        rows = evaluation.case_reports(told, results)
        reports = self.spark.createDataFrame(rows.collect(), rows.schema)  # one row a case
        if output:
            evaluation.write_text(self.spark, output, evaluation.report_text(reports, generated, kind))
        return reports

    def explain(self, query: str, profile: str | None = None, limit: int = 5) -> DataFrame:
        found = self.search(query, profile, limit).withColumn("weight", F.col("importance"))
        why = summary.why_matched(query_terms(query), F.col("vec_rank").isNotNull(), F.col("bm25_rank").isNotNull(), now_ms=self.now_ms)
        return views.explain_rows(found, reduce_paths(), why)

    def rows(self, query: str, profile: str | None = None, limit: int = 5) -> DataFrame:
        return views.projected(self.search(query, profile, limit), reduce_paths())

    def distill(self, query: str, profile: str | None = None, limit: int = 8) -> DataFrame:
        return views.distilled(self.search(query, profile, limit), query, resolve_profile(profile), reduce_paths())

    def brief(self, query: str, created_at: str, profile: str | None = None, limit: int = 8) -> DataFrame:
        """Makes a brief of what is no asset, saves it and stores its text; the brief."""
        found = summary.seeds(self.search(query, profile, limit))
        made = self.spark.createDataFrame(assets.build_briefs(views.distilled(found, query, resolve_profile(profile), reduce_paths()), created_at).collect(), assets.BRIEF)
        assets.save(made, f"{self.path}/briefs")
        self._index(assets.memory_rows(assets.brief_text(made), "memory-brief"))
        return made

    def pin(self, wanted: str, created_at: str) -> DataFrame:
        """Pins a row by its id or the beginning of it; the pin."""
        found = assets.build_pins(self.store.get(wanted), created_at)
        made = self.spark.createDataFrame(found.collect(), found.schema)
        if made.isEmpty():
            return made
        assets.save(made, f"{self.path}/pins")
        row = made.first()
        self.store.update(row.memory_id, importance=float(row.promoted))
        text = assets.pin_text(F.col("title"), F.col("summary"), F.col("snippet"), F.col("original_scope"), F.col("tags"))
        self._index(assets.memory_rows(made.withColumn("text", text), "pinned-memory"))
        return made

    def _index(self, rows: DataFrame) -> None:
        self.store.append(with_vectors(rows, self.embedder, dim=self.dim), self.now_ms)
        self.refresh()

    def briefs(self, limit: int = 20) -> DataFrame:
        return assets.read(self.spark, f"{self.path}/briefs", assets.BRIEF, limit)

    def pins(self, limit: int = 20) -> DataFrame:
        return assets.read(self.spark, f"{self.path}/pins", assets.PIN, limit)

    def get_pin(self, wanted: str) -> DataFrame:
        return assets.find_pin(self.spark, f"{self.path}/pins", wanted)

    def assets(self, needle: str = "", tag: str | None = None, limit: int = 12) -> DataFrame:
        """The newest pins and briefs that a word or a tag picks, with a line on each."""
        pins = self.pins(200).withColumn("scope", F.col("original_scope"))
        briefs = self.briefs(200).withColumn("scope", F.concat_ws(", ", F.transform("sources", lambda s: s["source"])))
        found = assets.filter_assets(assets.union_recent(pins, briefs, 400), needle, tag).orderBy(F.desc("created_at"), "id").limit(limit)
        line = F.when(F.col("type") == "memory-brief", assets.summary_line("brief", F.col("scope"))).otherwise(assets.summary_line("pin", F.col("scope")))
        return found.withColumn("line", line)

    def clean(self, remove: bool = False) -> DataFrame:
        """Those of the newest 200 briefs that are made of assets; with remove they go to the archive and their rows from the store. Nothing else is written."""
        bad = assets.dirty_briefs(self.briefs(200))
        gone = self.spark.createDataFrame(bad.collect(), bad.schema)
        if remove and not gone.isEmpty():
            self.store.bulk_delete_where(F.col("scope").isin([r.scope for r in gone.select("scope").collect()]))
            assets.archive(self.spark, f"{self.path}/briefs", f"{self.path}/archive", [r.id for r in gone.select("id").collect()])
            self.refresh()
        return gone

    def export(self, query: str, created_at: str, profile: str | None = None, limit: int = 8, kind: str = "md") -> DataFrame:
        """Writes the results of a search, with what they say, as a file; its name and content."""
        told = "\n".join(views.distill_lines(self.distill(query, profile, limit).first()))
        found = self.search(query, profile, limit).withColumn("path", reduce_paths())
        made = exports.build_exports(found.select("position", "id", "scope", "score", "timestamp_ms", "text", "metadata", "path", F.lit(query).alias("query"), F.lit(resolve_profile(profile)).alias("profile"), F.lit(created_at).alias("created_at"), F.lit(told).alias("summary")), kind)
        exports.write_exports(self.spark, made, f"{self.path}/exports")
        return made

    def exports(self, needle: str = "", limit: int = 20) -> DataFrame:
        return exports.filter_exports(exports.read_exports(self.spark, f"{self.path}/exports", limit), needle)

    def test(self) -> tuple[bool, str]:
        """Whether a search runs from end to end, and if not why."""
        try:
            self.embedder(["what is stored here at all"])
            return True, str(self.search("what is stored here at all", limit=1).count())
        except Exception as e:
            return False, str(e)
