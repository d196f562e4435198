"""From files to stored rows: read, pair, cut, embed, put in place of what the files gave before, mark."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import CONVERSATION, MARKDOWN, ChunkConfig, chunked
from ..functions.embedding import VectorCache
from ..operators.store import LEDGER, Store, new_files
from ..operators.turns import pair_turns
from ..sources import transcripts as R

__all__ = ["LEDGER", "busiest_folder", "detect", "ingest", "source_folder", "stream_ingest", "take_in"]

#: What reads each kind of source, which files it takes and whether those below its folder too.
CONVERSATIONS = {"cc": R.cc_turns, "codex": R.codex_turns, "gemini": R.gemini_turns}
GLOBS = {"cc": "*.jsonl", "codex": "*.jsonl", "gemini": "session-*.json", "markdown": "*.md", "generic": "*.{txt,md,json}"}
BELOW = ("codex", "gemini")
#: Folders of which the name alone says what they hold.
FOLDERS = {".claude": "cc", ".codex": "codex", ".gemini": "gemini", "memory": "markdown"}


def detect(spark: SparkSession, path: str) -> str:
    """The kind of source that a folder holds: by a folder's name on its path, or else by the names of its files."""
    for part in reversed(path.rstrip("/").split("/")):
        if part in FOLDERS:
            return FOLDERS[part]
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("n"))
    found = names.agg(F.count_if(F.col("n").rlike(r"^session-.*\.json$")).alias("gemini"), F.count_if(F.col("n").rlike(r"^rollout-.*\.jsonl$")).alias("codex"), F.count_if(F.col("n").endswith(".jsonl")).alias("cc"), F.count_if(F.col("n").endswith(".md")).alias("markdown")).first().asDict()
    return next((kind for kind in ("gemini", "codex", "cc", "markdown") if found[kind]), "generic")


def busiest_folder(spark: SparkSession, path: str, glob: str = "*.jsonl") -> str | None:
    """Of the folders directly in `path`, the one with the most files of such a name in it, of equals the first by name; None if there is none. Only names are read."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select(F.regexp_replace("path", "/[^/]+$", "").alias("folder"))
    root = fs.makeQualified(top).toString().rstrip("/")
    inside = files.where(F.regexp_replace("folder", "/[^/]+$", "") == root)
    first = inside.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "folder").first()
    return first.folder if first else None


def source_folder(spark: SparkSession, path: str, kind: str | None, projects: str = "~/.claude/projects") -> str:
    """Where a source is: `path` with the user's home in place of ~, or, for "auto", the busiest folder of `projects` and, of notes, the one named memory in it.

    "auto" is an error for other kinds and where no such folder is.
    """
    if path != "auto":
        return os.path.expanduser(path)
    if kind not in ("cc", "markdown"):
        raise ValueError(f"no folder is looked for by itself for {kind}; name it")
    found = busiest_folder(spark, os.path.expanduser(projects))
    if found is None:
        raise ValueError(f"no folder with transcripts in {projects}; name it")
    return f"{found}/memory" if kind == "markdown" else found


def long_parts(df: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """df (file, text, ...) with texts beyond cfg.size cut into chunks, each a row with its place in `part`."""
    whole = df.where(F.length("text") <= cfg.size).withColumn("part", F.lit(0).cast("long"))
    cut = chunked(df.where(F.length("text") > cfg.size), cfg)
    return whole.unionByName(cut.select(*(F.col("chunk").alias("text") if c == "text" else c for c in df.columns), F.col("chunk_ix").cast("long").alias("part")))


def rows_of(files: DataFrame, kind: str, watch: Observation | None = None) -> DataFrame:
    """file, text, scope, metadata, part of everything that files (file, content, size) hold, cut to size.

    Turns are paired, and pairs and sections beyond their size are cut, as are long texts of other files.
    """
    name = F.element_at(F.split("file", "/"), -1).alias("file")
    if kind in CONVERSATIONS:
        pairs = pair_turns(CONVERSATIONS[kind](files, watch), "file", "seq").select("file", F.col("pair").alias("text"), "session")
        rows = long_parts(pairs, CONVERSATION)
        scope = F.concat(F.lit(f"{kind}:"), F.substring("session", 1, 8))
        meta = F.to_json(F.struct(F.lit(kind).alias("source"), name, "session"))
    elif kind == "markdown":
        rows = long_parts(R.markdown_sections(files).select("file", "heading", "text"), MARKDOWN)
        scope = F.lit("memory")
        meta = F.to_json(F.struct(F.lit("memory").alias("source"), name, "heading"))
    else:
        rows = long_parts(R.generic_texts(files).select("file", "text"), MARKDOWN)
        scope = F.lit("generic")
        meta = F.to_json(F.struct(F.lit("generic").alias("source"), name))
    return rows.select("file", "text", scope.alias("scope"), meta.alias("metadata"), "part")


def read_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return rows_of(R.whole_files(spark, path, GLOBS[kind], kind in BELOW), kind)


def changed_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """files (file, size, modified, ...) that are new or have changed since they were marked, with mtime_ms."""
    timed = files.withColumn("mtime_ms", F.unix_millis("modified").cast("double"))
    return new_files(timed.withColumnRenamed("file", "path"), ledger).withColumnRenamed("path", "file")


def take_in(files: DataFrame, kind: str, store: Store, cache: VectorCache, now_ms: int, now: str) -> dict:
    """Stores what files (file, content, size, mtime_ms) hold in place of what they gave before, marks them, and tells totals.

    The sources are read once, into a table of the store, and counts are taken in that pass. Only totals come to the driver.
    A run that breaks off can be repeated: rows are put in by file, marks come last, and vectors that were made are kept.
    """
    tag = uuid.uuid4().hex
    broken, seen = Observation(f"broken-{tag}"), Observation(f"rows-{tag}")
    rows = rows_of(files, kind, broken if kind in CONVERSATIONS else None)
    watched = rows.observe(seen, F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("part") > 0).alias("cut"))
    staged, path = store.staged(watched)
    try:
        full, made = cache.vectors(staged)
        store.put_files(full.drop("part").withColumn("taken", F.lit(tag)), files, now_ms)
        counts = staged.groupBy("file").agg(F.count(F.lit(1)).alias("chunks"))
        marks = files.select("file", "size", "mtime_ms").join(counts, "file", "left").select(F.col("file").alias("path"), "size", "mtime_ms", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.lit(now).alias("ingested_at"))
        marked = Observation(f"files-{tag}")
        store.mark(marks.observe(marked, F.count(F.lit(1)).alias("files")))
    finally:
        store.forget(path)
    return {"files": marked.get["files"], **seen.get, "broken": broken.get["broken"] if kind in CONVERSATIONS else 0, "embedded": made}


def ingest(spark: SparkSession, path: str, store: Store, cache: VectorCache, now_ms: int, now: str, kind: str | None = None) -> dict:
    """Takes in the new and changed files of a folder; totals of files, chunks, chunks that were cut, broken lines and texts embedded."""
    kind = kind or detect(spark, path)
    files = changed_files(R.whole_files(spark, path, GLOBS[kind], kind in BELOW), store.ledger())
    if files.isEmpty():
        return dict.fromkeys(("files", "chunks", "cut", "broken", "embedded"), 0)
    return take_in(files, kind, store, cache, now_ms, now)


def stream_ingest(spark: SparkSession, path: str, kind: str, store: Store, cache: VectorCache, checkpoint: str, now_ms: int, now: str) -> list[dict]:
    """Takes in a folder as a stream: files that came since the last run in micro-batches, then those that changed; totals of each step.

    The checkpoint names the files that a run has seen. A micro-batch that is run again puts its files in place of
    themselves, so each row stands once whatever was lost; a changed file is found by the ledger.
    """
    told: list[dict] = []
    kinds = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(kinds).option("pathGlobFilter", GLOBS[kind]).option("recursiveFileLookup", kind in BELOW).load(path)
    files = R.file_rows(source).withColumn("mtime_ms", F.unix_millis("modified").cast("double"))

    def batch(df: DataFrame, number: int) -> None:
        told.append(take_in(df, kind, store, cache, now_ms, now))

    files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    told.append(ingest(spark, path, store, cache, now_ms, now, kind))
    return told
