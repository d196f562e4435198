"""Periodic runs of words: stretches of a text that repeat with a period, found after Kolpakov and Kucherov.

A text is factorised after Lempel and Ziv with its suffix automaton; Main's algorithm finds the runs that cross or touch
a border of two factors, and the others, which lie strictly inside a factor, are copied from where the factor occurred
before. All of it is linear in the length of the text. Stretches that no run can reach are left out first: every two
neighbouring words of a run occur a second time, except those on both sides of the middle of a run of just two periods.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import streamed, table

#: Words that a run has at least, besides two periods.
LEAST = 12
SPACES = r"[\x20\x09-\x0D]+"
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start) of the Lempel-Ziv factors: the longest that occurs from an earlier start on, or one new letter with -1."""
    after: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]  # first: the end of a state's first occurrence
    last = 0
    for i, c in enumerate(w):
        now = len(after)
        after.append({})
        link.append(0)
        size.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = now
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if size[p] + 1 == size[q]:
                link[now] = q
            else:
                twin = len(after)
                after.append(after[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    out, b, n = [], 0, len(w)
    while b < n:
        state, j = 0, b
        while j < n and first[to := after[state][w[j]]] < j:
            state = to
            j += 1
        out.append((b, j - b, first[state] - (j - b) + 1) if j > b else (b, 1, -1))
        b = max(j, b + 1)
    return out


def agreements(s: list[int]) -> list[int]:
    """For each place of s, how long what begins there agrees with the beginning of s (at 0: 0)."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def crossing(w: list[int], b: int, reach: int, size: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the maximal repetitions with start <= b <= end of which `reach` words before b and `size` from b on hold all."""
    n = len(w)
    before, behind = w[b - reach : b], w[b : b + size]
    ahead = agreements([*behind, -1, *before, *behind])
    back = before[::-1]
    behind_up = agreements([*back, -1, *behind[::-1], *back])
    for p in range(1, max(reach, size) + 1):
        spans = []
        if p <= size:  # a whole period stands behind the border
            right, left = (ahead[p] if p < size else 0), behind_up[reach + 1 + size - p]
            if left + right >= p:
                spans.append((b - left, b + p + right))
        if p <= reach:  # or before it
            right, left = ahead[size + 1 + reach - p], (behind_up[p] if p < reach else 0)
            if left + right >= p:
                spans.append((b - p - left, b + right))
        for s, e in spans:
            if e - s >= least and not (s and w[s - 1] == w[s - 1 + p]) and not (e < n and w[e] == w[e - p]):
                yield s, e, p


def runs_of(w: list[int], least: int = LEAST) -> dict[tuple[int, int], int]:
    """The smallest period of each run (start, end) of w that has max(least, 2 * period) words or more."""
    found: dict[tuple[int, int], int] = {}
    starts: dict[int, list[int]] = {}

    def add(s: int, e: int, p: int) -> None:
        was = found.get((s, e))
        if was is None:
            starts.setdefault(s, []).append(e)
        if was is None or p < was:
            found[s, e] = p

    previous = 0
    for b, size, source in [*factors(w), (len(w), 0, -1)]:
        # a run that ends in this factor begins less than this before it, or two factors would have an earlier occurrence
        reach = min(b, 2 * previous + size)
        if reach + size >= least:
            for run in crossing(w, b, reach, size, least):
                add(*run)
        if size > least and source >= 0:
            for s in range(source + 1, source + size):
                for e in starts.get(s, ()):
                    if e < source + size:
                        add(s + b - source, e + b - source, found[s, e])
        previous = size
    return found


def reachable(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches (start, end) of a text such that every run lies inside one of them."""
    n = len(ids)
    if n < least:
        return []
    pairs = ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:]
    _, back, count = np.unique(pairs, return_inverse=True, return_counts=True)
    bounds = np.concatenate(([0], np.flatnonzero(count[back] == 1) + 1, [n]))
    size = np.diff(bounds)
    if least <= 2:
        return [(0, n)]
    good = np.concatenate(([False], size >= (least + 1) // 2, [False]))
    edge = np.flatnonzero(good[1:] != good[:-1])
    spans = zip(bounds[edge[::2]].tolist(), bounds[edge[1::2]].tolist())
    return [(a, b) for a, b in spans if b - a >= least]


def runs_of_text(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs by start, then period."""
    if len(words) < least:
        return []
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(x, len(known)) for x in words], np.int64)
    return sorted((a + s, e - s, p) for a, b in reachable(ids, least) for (s, e), p in runs_of(ids[a:b].tolist(), least).items())


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, flat, ends, kept = [], [], [0], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                words = (raw or b"").split()
                own = runs_of_text(words, least)
                flat += own
                sizes.append(len(words))
                ends.append(len(flat))
                if own:
                    drop = np.zeros(len(words) + 1, np.int64)
                    for start, length, period in own:
                        drop[start + period] += 1
                        drop[start + length] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
                kept.append(b" ".join(words))
            cols = np.array(flat, np.int64).reshape(-1, 3).T
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in cols], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), runs, pa.array(kept, pa.binary()).view(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """One row (FOUND) per row of documents (doc_id, text): its words, its periodic runs and its text without their repeats.

    Words are what ASCII white space parts. A run is a stretch of words with smallest period q that has max(least, 2q)
    words or more and that no neighbouring word extends; runs come by start, then period. `collapsed` holds the words
    that no run contains after its first q, joined by one space. A null or empty text has no words and collapses to the
    empty text; repeated rows and null ids are judged like others; other columns, whatever their names, are ignored; an
    empty table gives no rows. A text is the work of one task, in memory linear in its longest stretch of repeated pairs.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return streamed(docs, _found(least), FOUND)


def made_periodic(text: Column, h: Column) -> Column:
    """text with a period from a word on, where the number h says so (h % 10 = 0); other texts, and all if h is null, stay."""
    words = F.array_remove(F.split(text, SPACES, -1), "")
    n = F.size(words)
    g = F.floor(h / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """One row per row of FOUND: number of runs, the longest one (ties: smallest start, then period) and checksums of all."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return digests(find_runs(docs.select("doc_id", made_periodic(F.col("text"), h).alias("text"))))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
SQL: dict[str, str] = {}
