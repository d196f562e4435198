"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_only, remainder, streamed, table
from .labelled import SAMPLE, fitted, training_sample

BUCKETS = 1 << 16
FACTORS = 8
EPOCHS = 6
KEEP = 0.7
MODULUS, HELD_OUT = 4, 2
#: Kinds of bytes: others, lower case, upper case, digits, sentence marks, other marks, spaces, line ends, parts of wider characters.
_KINDS = np.zeros(256, np.uint8)
_KINDS[0x61:0x7B], _KINDS[0x41:0x5B], _KINDS[0x30:0x3A] = 1, 2, 3
_KINDS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_KINDS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_KINDS[0x20], _KINDS[0x0A], _KINDS[0x80:] = 6, 7, 8


@lru_cache(maxsize=300_000)
def bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) % BUCKETS


def statistics(text: str, words: list[str], n_chars: int | None) -> list[float]:
    """Structure of the text, and the metadata n_chars; all are bounded or logarithms."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KINDS[raw], minlength=9) / max(1, len(raw))
    lines = text.split("\n")
    n = max(1, len(words))
    ends = sum(text.count(c) for c in ".!?")
    return [
        *kinds.tolist(),
        np.log1p(len(text)),
        np.log1p(len(words)),
        np.log1p(len(text) / n),
        np.log1p(n / max(1, ends)),
        np.log1p(n / len(lines)),
        len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
        sum(map(str.isupper, words)) / n,
        1 - sum(map(str.isalpha, words)) / n,
        np.log1p(max(map(len, words), default=0)),
        np.log1p(n_chars if n_chars is not None and n_chars > 0 else 0),
        float(n_chars is None),
    ]


N_STATS = len(statistics("", [], None))


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(buckets of the whole text's lower-case words, their unit-length counts, statistics)."""
    text = text or ""
    words = text.split()
    ids, count = np.unique(np.fromiter(map(bucket, map(str.lower, words)), np.int64, len(words)), return_counts=True)
    weight = np.log1p(count)
    return ids, weight / max(1e-12, float(np.sqrt((weight * weight).sum()))), statistics(text, words, n_chars)


class FactorisationMachine:
    """w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), through a logistic link."""

    def __init__(self, dims: int, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(dims)
        self.v = rng.normal(0, 0.01, (dims, factors))

    def raw(self, idx: np.ndarray, val: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Of rows given as CSR, in time linear in their entries."""
        vx = self.v[idx] * val[:, None]
        start = ptr[:-1]
        total = np.add.reduceat(vx, start)
        return self.w0 + np.add.reduceat(self.w[idx] * val, start) + 0.5 * (total * total - np.add.reduceat(vx * vx, start)).sum(1)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-5, batch: int = 256, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        m = [np.zeros_like(x) for x in (self.w, self.v)]
        s = [np.zeros_like(x) for x in (self.w, self.v)]
        m0 = s0 = 0.0
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                some = order[at : at + batch]
                idx = np.concatenate([rows[i][0] for i in some])
                val = np.concatenate([rows[i][1] for i in some])
                sizes = np.array([len(rows[i][0]) for i in some])
                ptr = np.append(0, np.cumsum(sizes))
                vx = self.v[idx] * val[:, None]
                total = np.add.reduceat(vx, ptr[:-1])
                z = self.w0 + np.add.reduceat(self.w[idx] * val, ptr[:-1]) + 0.5 * (total * total - np.add.reduceat(vx * vx, ptr[:-1])).sum(1)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
                ge = np.repeat(g, sizes)
                used, back = np.unique(idx, return_inverse=True)
                gw = np.bincount(back, ge * val, len(used)) + decay * self.w[used]
                gv = (ge * val)[:, None] * (np.repeat(total, sizes, 0) - vx)
                gv = np.stack([np.bincount(back, gv[:, f], len(used)) for f in range(gv.shape[1])], 1) + decay * self.v[used]
                step += 1
                for x, grad, a, b in ((self.w, gw, m[0], s[0]), (self.v, gv, m[1], s[1])):  # Adam, for the features that occur
                    a[used] = 0.9 * a[used] + 0.1 * grad
                    b[used] = 0.99 * b[used] + 0.01 * grad * grad
                    x[used] -= rate * (a[used] / (1 - 0.9**step)) / (np.sqrt(b[used] / (1 - 0.99**step)) + 1e-8)
                m0, s0 = 0.9 * m0 + 0.1 * g.sum(), 0.99 * s0 + 0.01 * g.sum() ** 2
                self.w0 -= rate * (m0 / (1 - 0.9**step)) / (np.sqrt(s0 / (1 - 0.99**step)) + 1e-8)


def logistic_1d(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a z + b))), by Newton steps with slightly smoothed labels."""
    a, b = 1.0, 0.0
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, h = p - t, np.maximum(p * (1 - p), 1e-9)
        haa, hab, hbb = (h * z * z).sum() + 1e-3, (h * z).sum(), h.sum() + 1e-3
        ga, gb = (r * z).sum() + 1e-3 * (a - 1), r.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 5 / max(abs(da), abs(db), 1e-9))
        a, b = max(1e-3, a - scale * da), b - scale * db
    return float(a), float(b)


class QualityModel:
    """Scales statistics as the sample has them, scores by the machine and calibrates on every fifth document of the sample."""

    def __init__(self, docs: list[tuple[str | None, int | None, int]]):
        y = np.array([d[2] for d in docs], float)
        self.constant = None if len(set(y.tolist())) > 1 else float(y.mean()) if len(y) else 0.5
        if self.constant is not None:
            return
        found = [features(t, n) for t, n, _ in docs]
        stats = np.array([f[2] for f in found])
        self.mean, self.scale = stats.mean(0), stats.std(0) + 1e-6
        rows = [self.row(f) for f in found]
        del found
        bucket.cache_clear()
        check = np.arange(len(rows)) % 5 == 0
        self.machine = FactorisationMachine(BUCKETS + N_STATS)
        self.machine.fit([r for r, c in zip(rows, check) if not c], y[~check])
        raw = self.scores_raw([r for r, c in zip(rows, check) if c])
        both = len(set(y[check].tolist())) > 1
        self.a, self.b = logistic_1d(raw, y[check]) if both else (1.0, 0.0)

    def row(self, f: tuple) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((np.array(f[2]) - self.mean) / self.scale, -4, 4)
        return np.append(f[0], np.arange(BUCKETS, BUCKETS + N_STATS)), np.append(f[1], z)

    def scores_raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        ptr = np.append(0, np.cumsum([len(r[0]) for r in rows]))
        return self.machine.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), ptr)

    def score(self, texts: list[str | None], n_chars: list[int | None]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        out: list[float] = []
        for i in range(0, len(texts), 128):
            z = self.scores_raw([self.row(features(t, n)) for t, n in zip(texts[i : i + 128], n_chars[i : i + 128])])
            out += (1 / (1 + np.exp(-np.clip(self.a * z + self.b, -30, 30)))).tolist()
        return out


def fit_quality(documents: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> QualityModel:
    """Fits on at most `limit` labelled documents, none of them held out; without both labels the score is a constant."""
    n_chars = F.col("n_chars").cast("long") if "n_chars" in documents.columns else F.lit(None).cast("long")
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_chars.alias("n_chars"))
    sample = training_sample(own, labels, "quality", MODULUS, HELD_OUT, limit)
    return fitted(sample.select("text", "n_chars", "y", "doc_id"), QualityModel)


def add_quality(spark: SparkSession, documents: DataFrame, model: QualityModel, name: str = "quality_score") -> DataFrame:
    """documents with the score in column `name`, in the same partitions: no shuffle, whole texts.

    Null and empty texts get the score of their statistics; rows that repeat each get the same score, an empty table
    stays empty. All other columns pass through; one that is already called `name` is an error.
    """
    if name.lower() in map(str.lower, documents.columns):
        raise ValueError(f"documents have a column {name} already")
    from pyspark.sql import types as T

    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(bucket.cache_clear)
        for batch in batches:
            chars = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else [None] * batch.num_rows
            scores = [s for i in range(0, batch.num_rows, 512) for s in shared.value.score(batch.column("text").slice(i, 512).to_pylist(), chars[i : i + 512])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return streamed(documents, run, T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())]))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = add_quality(spark, docs.select("doc_id", "text", "n_chars"), model, "score")
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


QUERIES = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}
