"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in whole documents.

The symbols are words. A block of two words (one, for windows of one word) indexes a table of shifts: a block
that no window holds lets the search skip almost a whole window; a block that ends windows leads to a bucket
by the block, whose windows are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, fresh_names, keep_only, streamed, table, written

WINDOW = 10
#: Words of benchmark items that one pass over the documents takes, about 200 MB of tables; further items take further passes.
PASS_WORDS = 500_000
#: The columns that a search adds.
OWN = ("n_words", "spans", "items")
#: Lower-cases A-Z and turns every byte that is in no word into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b in range(0x30, 0x3A) or b in range(0x61, 0x7B) or b >= 0x80 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class WuManber:
    """All windows of one length: shift by block, and windows by the block that ends them."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict = {}
        self.bucket: dict = {}

    def add(self, window: tuple, item) -> None:
        n, b = self.length, self.block
        for i in range(b, n + 1):
            key = window[i - b : i] if b > 1 else window[i - 1]
            self.shift[key] = min(self.shift.get(key, n - i), n - i)
        key = window[n - b :] if b > 1 else window[-1]
        self.bucket.setdefault(key, {}).setdefault(window, set()).add(item)

    def find(self, words: list) -> Iterator[tuple[int, set]]:
        """(position of the first word, items) of every occurrence."""
        n, b, shift, bucket, far = self.length, self.block, self.shift.get, self.bucket, self.length - self.block + 1
        at, end = n - 1, len(words)
        while at < end:
            key = (words[at - 1], words[at]) if b > 1 else words[at]
            step = shift(key, far)
            if step:
                at += step
                continue
            for window, items in bucket[key].items():
                if window[0] == words[at - n + 1] and tuple(words[at - n + 1 : at + 1]) == window:
                    yield at - n + 1, items
            at += 1


class Searcher:
    """Wu-Manber tables for the windows of items, one set for each window length."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.by_length: dict[int, WuManber] = {}
        for item, text in items:
            words = words_of(text)
            n = min(window, len(words))
            if n:
                table = self.by_length.setdefault(n, WuManber(n))
                for i in range(len(words) - n + 1):
                    table.add(tuple(words[i : i + n]), item)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Half-open spans of hit words, merged and in order, and the items found."""
        spans, items = [], set()
        for n, one in self.by_length.items():
            for at, found in one.find(words):
                spans.append((at, at + n))
                items |= found
        return merged(spans), items


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(tables, window: int, own: tuple[str, str, str]):
    """Adds what one block of items hits to the columns named by own: n_words, spans (pairs of ints in one list) and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        search = Searcher(tables.value, window).search
        for batch in batches:
            n_words, spans, items = [], [], []
            for text, s, known in zip(batch.column("text"), batch.column(own[1]).to_pylist(), batch.column(own[2]).to_pylist()):
                words = words_of(text.as_py())
                found, ids = search(words)
                n_words.append(len(words))
                if s:
                    found = merged([*zip(s[::2], s[1::2]), *found])
                spans.append([x for span in found for x in span])
                items.append(sorted({*known, *(i for i in ids if i is not None)}))
            for name, column in zip(own, (pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())))):
                batch = batch.set_column(batch.schema.get_field_index(name), name, column)
            yield batch

    return run


def find_contamination(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """The documents (doc_id, text) with n_words, spans (starts and ends of hit words in turn) and items (ids as strings, sorted).

    A window is `window` consecutive words of an item, all of its words if it has fewer; items without words
    and null texts have none. An item with a null id marks words as hit and is named nowhere. Items are taken in blocks of about pass_words words: each block is one pass over
    the documents, and only one block's items are on the driver and in a broadcast at a time. Nothing is shuffled. Repeated
    documents each get their own row.
    """
    return _search(spark, documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, pass_words, OWN)


def _search(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int, pass_words: int, own: tuple[str, str, str]) -> DataFrame:
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    size = bench.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0))).first()[0]
    blocks = int(size // pass_words) + 1
    docs = documents.select("*", *(v.cast(kind).alias(name) for v, kind, name in zip((F.lit(0), F.array(), F.array()), ("long", "array<long>", "array<string>"), own)))
    last = None  # the pass before
    for b in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        tables = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        docs = streamed(docs, _pass(tables, window, own), docs.schema)
        if b < blocks - 1:
            docs = written(spark, docs, "decontaminate")
            if last is not None:
                forget(spark, last)
            last = docs
    return docs


def drop_contaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents, all columns, without those in which any window occurs. Rows are judged one by one where they are."""
    own = tuple(fresh_names(documents.columns, *OWN))
    found = _search(spark, documents, benchmark, window, PASS_WORDS, own)
    return found.where(F.size(own[1]) == 0).drop(*own)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    pairs = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", pairs.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (pairs > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
QUERIES = {"op5_decontamination": op5_decontamination}
SQL = {
    "op5_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT item, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n, win, item FROM bw),
dw AS (SELECT rid, n, i, list_slice(w, i, i + n - 1) AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
hits AS (SELECT dw.rid, dw.n, dw.i, k.item FROM dw JOIN k ON dw.n = k.n AND dw.win = k.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
}
