"""Chunks of long texts, cut near sentence ends, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import slices, streamed

ENDS = re.compile(r"[.!?。！？]")


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 4000
    overlap: int = 200
    least: int = 200
    lines: int = 50
    semantic: bool = True


DEFAULT, CONVERSATION, MARKDOWN = ChunkConfig(), ChunkConfig(2000, 100, 100, 40), ChunkConfig(1500, 100, 80, 30)
#: Context lengths of embedding models, in characters.
CONTEXT = {
    "jina-embeddings-v5-text-small": 8192,
    "jina-embeddings-v5-text-nano": 8192,
    "text-embedding-3-small": 8192,
    "text-embedding-3-large": 8192,
    "text-embedding-004": 8192,
    "gemini-embedding-001": 2048,
    "nomic-embed-text": 8192,
    "all-MiniLM-L6-v2": 512,
    "all-mpnet-base-v2": 512,
}


def for_model(name: str) -> ChunkConfig:
    limit = CONTEXT.get(name, 8192)
    return ChunkConfig(max(1000, int(limit * 0.7)), int(limit * 0.05), max(100, int(limit * 0.1)), 50)


def _end(text: str, start: int, stop: int, least: int, cfg: ChunkConfig) -> int:
    least = min(max(least, start + 1), stop)
    if cfg.lines > 0 and len(re.findall(r"\r\n|\n|\r", text[start:stop])) + 1 > cfg.lines:
        at = start - 1
        for _ in range(cfg.lines):
            at = text.find("\n", at + 1, stop)
            if at < 0:
                break
        else:
            return max(at + 1, least)
    span = range(stop - 1, least - 1, -1)
    if cfg.semantic:
        for i in span:
            if ENDS.match(text[i]):
                i += 1
                while i < stop and text[i].isspace():
                    i += 1
                return i
        i = text.rfind("\n", least, stop)
        if i >= 0:
            return i + 1
    return next((i for i in span if text[i].isspace()), stop)


def _trimmed(text: str, a: int, b: int) -> tuple[str, int, int]:
    part = text[a:b]
    left = len(part) - len(part.lstrip())
    part = part.strip()
    return part, a + left, a + left + len(part)


def chunk(text: str | None, cfg: ChunkConfig = DEFAULT) -> list[tuple[str, int, int]]:
    """(chunk, start, end) of the text; every character but white space at cuts is in one, since each step moves on."""
    out: list[tuple[str, int, int]] = []
    if not text or not text.strip():
        return out
    at = 0
    while at < len(text):
        if len(text) - at <= cfg.size:
            found, stop = _trimmed(text, at, len(text)), len(text)
        else:
            limit = at + cfg.size
            stop = _end(text, at, limit, at + cfg.least, cfg)
            found = _trimmed(text, at, stop)
            if len(found[0]) < cfg.least:
                found, stop = _trimmed(text, at, limit), limit
        if found[0]:
            out.append(found)
        if stop >= len(text):
            break
        at = max(stop - cfg.overlap, at + 1)
    return out


def chunked(df: DataFrame, cfg: ChunkConfig = DEFAULT, column: str = "text") -> DataFrame:
    """A row for each chunk, with chunk_ix, chunk, start_ix, end_ix after the other columns."""
    own = ["chunk_ix", "chunk", "start_ix", "end_ix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows, more = [], [[], [], [], []]
            for i, text in enumerate(batch.column(column).to_pylist()):
                for j, (c, a, b) in enumerate(chunk(text, cfg)):
                    rows.append(i)
                    for col, v in zip(more, (j, c, a, b)):
                        col.append(v)
            kept = batch.take(pa.array(rows, pa.int64()))
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, more, kinds)], [*batch.schema.names, *own])

    fields = [T.StructField("chunk_ix", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("start_ix", T.IntegerType()), T.StructField("end_ix", T.IntegerType())]
    return streamed(df, run, T.StructType([*df.schema.fields, *fields]))
