"""Readers of transcripts and notes; each gives (file, seq, role, text, event_time, session) or sections of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trim
from ..operators.turns import fill_session

#: Smaller files hold no conversation.
LEAST_BYTES = {"cc": 500, "codex": 200, "gemini": 100}
#: Fixed value: shorter texts are no notes.
LEAST_CHARS = 50


def whole_files(spark: SparkSession, path: str, glob: str, recursive: bool = False, least: int = 0) -> DataFrame:
    """file, content, size, modified of the text files whose names fit the glob."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).option("ignoreMissingFiles", True)
    return file_rows(read.load(path)).where(F.col("size") >= least)


def file_rows(files: DataFrame) -> DataFrame:
    """file, content, size, modified of a binary file source, a row a file even where the content is not asked for."""
    return files.select(F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def large_enough(files: DataFrame, kind: str) -> DataFrame:
    return files.where(F.col("size") >= LEAST_BYTES.get(kind, 0))


def _counted(parsed: DataFrame, watch: Observation | None) -> DataFrame:
    """The rows that are JSON; watch gets the number of the others as `broken`, in the pass that reads them."""
    parsed = parsed.observe(watch, F.count_if(F.col("j").isNull()).alias("broken")) if watch else parsed
    return parsed.where("j is not null")


def _lines(files: DataFrame, watch: Observation | None = None) -> DataFrame:
    lines = files.select("file", F.posexplode(F.split("content", "\n")).alias("line", "raw")).where(trim(F.col("raw")) != "")
    return _counted(lines.select("file", "line", F.try_parse_json("raw").alias("j")), watch)


def _get(column: str, path: str, kind: str = "string"):
    return F.try_variant_get(column, path, kind)


def read_cc(spark: SparkSession, path: str) -> DataFrame:
    return cc_turns(whole_files(spark, path, "*.jsonl"))


def cc_turns(files: DataFrame, watch: Observation | None = None) -> DataFrame:
    """JSON lines of type user or assistant; a content is a string or blocks, of which the texts are joined."""
    j = _lines(large_enough(files, "cc"), watch)
    blocks = _get("j", "$.message.content", "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    text = F.when(F.schema_of_variant(F.variant_get("j", "$.message.content", "variant")) == "STRING", _get("j", "$.message.content")).otherwise(joined)
    t = j.select("file", F.col("line").alias("seq"), _get("j", "$.type").alias("role"), trim(F.coalesce(text, F.lit(""))).alias("text"), F.coalesce(_get("j", "$.timestamp"), F.lit("")).alias("event_time"), _get("j", "$.sessionId").alias("sid"))
    t = fill_session(t, "file", "seq", "sid", first=True).drop("sid")
    return t.where(((F.col("role") == "user") & (F.length("text") > 10)) | ((F.col("role") == "assistant") & (F.length("text") > 20)))


def read_codex(spark: SparkSession, path: str) -> DataFrame:
    return codex_turns(whole_files(spark, path, "*.jsonl", recursive=True))


def codex_turns(files: DataFrame, watch: Observation | None = None) -> DataFrame:
    """Response items with typed blocks, and user events unless they repeat the turn before."""
    j = _lines(large_enough(files, "codex"), watch)
    kind = _get("j", "$.type")
    blocks = F.when(kind == "response_item", _get("j", "$.payload.content", "array<struct<type:string,text:string>>"))
    event = F.when((kind == "event_msg") & (_get("j", "$.payload.type") == "user_message"), F.array(F.struct(F.lit("event").alias("type"), _get("j", "$.payload.message").alias("text"))))
    j = j.select("file", "line", F.coalesce(_get("j", "$.timestamp"), F.lit("")).alias("event_time"), _get("j", "$.payload.role").alias("by"), F.when(kind == "session_meta", _get("j", "$.payload.id")).alias("sid"), F.coalesce(blocks, event).alias("blocks"))
    j = fill_session(j, "file", "line", "sid", first=False)
    t = j.select("file", "line", "event_time", "by", "session", F.posexplode("blocks").alias("pos", "b")).select("file", F.struct("line", "pos").alias("seq"), "event_time", "session", "by", F.col("b.type").alias("kind"), F.col("b.text").alias("raw"))
    n = F.length("raw")
    asked = (F.col("kind") == "input_text") & (n > 10) & (F.coalesce("by", F.lit("")) != "developer") & ~F.contains("raw", F.lit("<permissions instructions>"))
    t = t.where(asked | ((F.col("kind") == "output_text") & (n > 20)) | ((F.col("kind") == "event") & (n > 10))).withColumn("text", trim(F.col("raw")))
    before = F.lag("text").over(W.partitionBy("file").orderBy("seq"))
    t = t.withColumn("_before", before).where((F.col("kind") != "event") | F.col("_before").isNull() | (F.col("_before") != F.col("text")))
    return t.select("file", "seq", F.when(F.col("kind") == "output_text", "assistant").otherwise("user").alias("role"), "text", "event_time", "session")


def read_gemini(spark: SparkSession, path: str) -> DataFrame:
    return gemini_turns(whole_files(spark, path, "session-*.json", recursive=True))


def gemini_turns(files: DataFrame, watch: Observation | None = None) -> DataFrame:
    """One JSON document a file; information messages and texts under ten characters are left out."""
    f = _counted(large_enough(files, "gemini").select("file", F.try_parse_json("content").alias("j")), watch)
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", "")
    m = f.select("file", F.coalesce(_get("j", "$.sessionId"), name).alias("session"), F.coalesce(_get("j", "$.startTime"), F.lit("")).alias("event_time"), F.posexplode(_get("j", "$.messages", "array<variant>")).alias("seq", "m"))
    parts = F.array_join(F.transform(F.filter(_get("m", "$.content", "array<struct<text:string>>"), lambda x: x["text"].isNotNull()), lambda x: x["text"]), "\n")
    text = F.when(F.schema_of_variant(F.variant_get("m", "$.content", "variant")) == "STRING", _get("m", "$.content")).otherwise(parts)
    t = m.select("file", "seq", _get("m", "$.type").alias("kind"), trim(F.coalesce(text, F.lit(""))).alias("text"), "event_time", "session").where((F.col("kind") != "info") & (F.length("text") >= 10))
    return t.select("file", "seq", F.when(F.col("kind") == "user", "user").otherwise("assistant").alias("role"), "text", "event_time", "session")


def markdown_sections(files: DataFrame) -> DataFrame:
    """file, section, heading, text of the sections of (file, content) under headings of one to three marks."""
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    lines = files.select("file", stem.alias("stem"), F.posexplode(F.split("content", "\n")).alias("line", "raw"))
    w = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    head = F.col("raw").rlike(r"^#{1,3}\s+.+$")
    lines = lines.withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line", "raw")))), lambda s: s["raw"]), "\n")
    out = lines.groupBy("file", "section").agg(F.coalesce(F.max(F.when(F.col("head"), trim(F.regexp_replace("raw", r"^#+\s+", "")))), F.first("stem")).alias("heading"), trim(body).alias("body"))
    return out.where(F.length("body") > 30).select("file", "section", "heading", F.concat(F.lit("["), "heading", F.lit("] "), "body").alias("text"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return markdown_sections(whole_files(spark, path, "*.md"))


def read_generic(spark: SparkSession, path: str, glob: str = "*.{txt,md,json}") -> DataFrame:
    return generic_texts(whole_files(spark, path, glob))


def generic_texts(files: DataFrame) -> DataFrame:
    """file, text of texts of 50 characters or more; JSON arrays become paragraphs of their items."""
    f = files.where(F.length(trim(F.col("content"))) >= LEAST_CHARS)
    items = F.try_variant_get(F.try_parse_json("content"), "$", "array<variant>")

    def shown(x):
        role, body = F.try_variant_get(x, "$.role", "string"), F.try_variant_get(x, "$.content", "string")
        return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).when(body.isNotNull(), F.concat(F.lit("["), F.coalesce(role, F.lit("?")), F.lit("] "), body)).otherwise(F.to_json(x))

    text = F.when(F.col("file").endswith(".json") & items.isNotNull(), F.array_join(F.transform(items, shown), "\n\n")).otherwise(F.col("content"))
    return f.select("file", text.alias("text"))
