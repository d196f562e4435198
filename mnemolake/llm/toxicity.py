"""Toxicity: a linear-chain conditional random field tags toxic words; marginals give spans and document scores.

Labels mark whole documents, so the tokens to learn from are labelled first: a word of a toxic document is
toxic if it, or a prefix of it, occurs in toxic sample documents far more often than chance allows. The field's
two tags have transition weights and emission weights of hashed words, prefixes and suffixes. Each line of a
text is a chain of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_only, remainder, streamed, table
from .labelled import fitted, training_sample
from .quality import logistic_1d

BUCKETS = 1 << 18
#: Labelled documents that the field is fitted on at most.
FIT_DOCS = 4000
MODULUS, HELD_OUT = 5, 0
TOXIC = 0.5
#: Marginal from which a word belongs to a span.
SPAN = 0.5
#: Evidence, in nats against chance, that a word or prefix must have to label tokens.
EVIDENCE = 13.0
#: Share of the documents with it that must be toxic.
PRECISION = 0.9
CACHE_WORDS = 250_000
#: Words of a chain in fitting; scoring takes whole lines.
FIT_WORDS = 64
#: Clean chains to each toxic one in the first fit; the second adds every clean chain that the first takes for toxic.
PLAIN_PER_TOXIC = 2
_EDGES = re.compile(r"^\W+|\W+$")
_hash = xxhash.xxh3_64_intdigest
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def parts_of(word: str) -> list[str]:
    """The features of a token: the word in lower case without marks around it, its prefixes and its suffix."""
    w = word.lower()
    if not w.isalnum():
        w = _EDGES.sub("", w)
    n = len(w)
    out = ["w:" + w, "s:" + w[-3:]]
    if n > 3:
        out.append("3:" + w[:3])
        if n > 4:
            out.append("4:" + w[:4])
            if n > 5:
                out.append("5:" + w[:5])
                if n > 6:
                    out.append("6:" + w[:6])
    return out


def _ids(word: str) -> list[int]:
    return [_hash(p) % BUCKETS for p in parts_of(word)]


def marginals(potential: np.ndarray, sizes: np.ndarray, trans: np.ndarray, with_odds: bool = False):
    """Marginals of tag 1 for chains given one after another, by the forward-backward algorithm.

    potential is each token's log weight of tag 1 against tag 0; trans[i, j] is the log weight of tag j after
    tag i. Chains run side by side, longest first, one position at a time; forward and backward weights are
    kept as ratios of the two tags, so nothing overflows.
    """
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    long = sizes[order]
    e = np.exp(np.clip(potential, -40, 40))
    t00, t01, t10, t11 = np.exp(trans).ravel()
    top = int(long[0]) if len(long) else 0
    alive = np.searchsorted(-long, -np.arange(1, top + 1), "right")
    ahead, back = np.empty(len(potential)), np.empty(len(potential))
    for i in range(top):
        at = start[: alive[i]] + i
        if i:
            r = ahead[at - 1]
            ahead[at] = e[at] * (t01 + r * t11) / (t00 + r * t10)
        else:
            ahead[at] = e[at]
    for i in range(top - 1, -1, -1):
        at = start[: alive[i]] + i
        n = alive[i + 1] if i + 1 < top else 0
        back[at[n:]] = 1.0
        x = e[at[:n] + 1] * back[at[:n] + 1]
        back[at[:n]] = (t10 + x * t11) / (t00 + x * t01)
    odds = ahead * back
    p = odds / (1 + odds)
    return (p, ahead, back) if with_odds else p


class ChainField:
    """The field: bias, hashed emission weights and 2 x 2 transitions."""

    def __init__(self):
        self.theta, self.bias, self.trans = np.zeros(BUCKETS), 0.0, np.zeros((2, 2))
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def fit(self, chains: list[list[str]], tags: list[list[int]], steps: int = 60, rate: float = 0.25, decay: float = 1e-4) -> None:
        """Adam on the mean conditional log likelihood; the gradient is what is seen less what the marginals expect."""
        sizes = np.array([len(c) for c in chains])
        words = [w for c in chains for w in c]
        index: dict[str, int] = {}
        which = np.array([index.setdefault(w, len(index)) for w in words])
        lists = [_ids(w) for w in index]
        flat = np.array([i for x in lists for i in x])
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        y = np.array([t for c in tags for t in c], float)
        inner = np.ones(len(words), bool)
        inner[np.cumsum(sizes) - sizes] = False
        here = np.flatnonzero(inner)
        seen = np.array([[((1 - y[here - 1]) * (1 - y[here])).sum(), ((1 - y[here - 1]) * y[here]).sum()], [(y[here - 1] * (1 - y[here])).sum(), (y[here - 1] * y[here]).sum()]])
        n = len(chains)
        m, s = [np.zeros(BUCKETS), 0.0, np.zeros((2, 2))], [np.zeros(BUCKETS), 0.0, np.zeros((2, 2))]
        for step in range(1, steps + 1):
            per = np.bincount(owner, self.theta[flat], len(lists)) + self.bias
            pot = per[which]
            p, ahead, back = marginals(pot, sizes, self.trans, True)
            w = np.exp(self.trans)
            e, f = np.exp(np.clip(pot, -40, 40)), ahead[here - 1]
            right = np.stack([np.ones(len(here)), e[here] * back[here]], 1)
            pair = np.stack([np.ones(len(here)), f], 1)[:, :, None] * w[None] * right[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            g = np.bincount(which, p - y, len(lists))
            grads = [np.bincount(flat, g[owner], BUCKETS) / n + decay * self.theta, float((p - y).sum()) / n, (pair.sum(0) - seen) / n + decay * self.trans]
            new = []
            for k, (x, grad) in enumerate(zip((self.theta, self.bias, self.trans), grads)):
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.99 * s[k] + 0.01 * grad * grad
                new.append(x - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8))
            self.theta, self.bias, self.trans = new

    def potentials(self, words: list[str]) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        found = list(map(self.cache.get, words))
        if None in found:
            weight, bias = self.theta.item, float(self.bias)
            for w in {w for w, v in zip(words, found) if v is None}:
                self.cache[w] = bias + sum([weight(_hash(p) % BUCKETS) for p in parts_of(w)])
            found = list(map(self.cache.__getitem__, words))
        return np.array(found, float)

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of all words of all texts, number of words of each text)."""
        words: list[str] = []
        sizes, per_text = [], []
        for t in texts:
            n = 0
            for line in (t or "").split("\n"):
                found = line.split()
                if found:
                    words += found
                    sizes.append(len(found))
                    n += len(found)
            per_text.append(n)
        return marginals(self.potentials(words), np.array(sizes, np.int64), self.trans), np.array(per_text)


def token_labels(docs: list[tuple[str | None, int]]) -> set[str]:
    """The features (words and prefixes) that mark a token of a toxic document as toxic."""
    n = [sum(y == 0 for _, y in docs), sum(y == 1 for _, y in docs)]
    if not n[1] or not n[0]:
        return set()
    toxic: Counter = Counter()
    for text, y in docs:
        if y:
            toxic.update({p for w in set((text or "").split()) for p in parts_of(w) if p[0] != "s"})
    toxic = Counter({p: c for p, c in toxic.items() if c >= 3})  # fewer is no evidence at any rate
    clean: Counter = Counter()
    shared: dict[str, tuple[str, ...]] = {}  # of a word, the parts that toxic documents have too
    for text, y in docs:
        if y:
            continue
        if len(shared) > CACHE_WORDS:
            shared = {}
        here: set[str] = set()
        for w in set((text or "").split()):
            found = shared.get(w)
            if found is None:
                found = shared[w] = tuple([p for p in parts_of(w) if p in toxic])
            here.update(found)
        clean.update(here)
    rate = n[1] / (n[0] + n[1])
    out = set()
    for p, c in toxic.items():
        share = min(c / (c + clean[p]), 1 - 1e-12)
        if share >= PRECISION and (c + clean[p]) * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate))) >= EVIDENCE:
            out.add(p)
    return out


class ToxicityModel:
    def __init__(self, docs: list[tuple[str | None, int]]):
        y = np.array([d[1] for d in docs])
        marks = token_labels(docs)
        self.constant = None if marks else float(y.mean()) if len(y) else 0.5
        if self.constant is not None:
            return
        chains, tags, plain = [], [], []
        known: dict[str, int] = {}
        same: dict[str, str] = {}

        def mark(w: str) -> int:
            if w not in known:
                known[w] = int(any(p in marks for p in parts_of(w)))
            return known[w]

        for text, label in docs:
            for line in (text or "").split("\n"):
                words = [same.setdefault(w, w) for w in line.split()]  # one string for each different word
                for i in range(0, len(words), FIT_WORDS):
                    some = words[i : i + FIT_WORDS]
                    t = [mark(w) for w in some] if label else [0] * len(some)
                    if any(t):
                        chains.append(some)
                        tags.append(t)
                    else:
                        plain.append(some)
        step = max(1, len(plain) // max(1, PLAIN_PER_TOXIC * len(chains)))
        for words in plain[::step]:
            chains.append(words)
            tags.append([0] * len(words))
        self.field = ChainField()
        self.field.fit(chains, tags)
        hard = []  # clean chains that the first fit takes for toxic
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            sizes = np.array([len(c) for c in some])
            odd = np.maximum.reduceat(marginals(self.field.potentials([w for c in some for w in c]), sizes, self.field.trans), np.cumsum(sizes) - sizes)
            hard += [some[j] for j in np.flatnonzero(odd > 0.1)]
        self.field.cache = {}
        del plain, same
        self.field.fit(chains + hard, tags + [[0] * len(c) for c in hard], steps=30, rate=0.1)
        self.a, self.b = 1.0, 0.0
        z = self.raw([t for t, _ in docs])
        self.a, self.b = logistic_1d(z, y.astype(float))
        self.field.cache = {}

    def raw(self, texts: list[str | None]) -> np.ndarray:
        return np.concatenate([self._raw(*self.field.tag(texts[i : i + 128])) for i in range(0, len(texts), 128)]) if texts else np.zeros(0)

    @staticmethod
    def _raw(p: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """The greatest log odds of a text's words; -20 for a text without words."""
        odds = np.log(np.clip(p, 1e-9, 1 - 1e-9)) - np.log1p(-np.clip(p, 1e-9, 1 - 1e-9))
        out = np.full(len(per_text), -20.0)
        some = np.flatnonzero(per_text)
        if len(some):
            out[some] = np.maximum.reduceat(odds, (np.cumsum(per_text) - per_text)[some])
        return out

    def score(self, texts: list[str | None]) -> tuple[list[float], list[list[tuple[int, int]]]]:
        """Scores, and the offsets (in characters) of the toxic spans of whole texts."""
        if self.constant is not None:
            return [self.constant] * len(texts), [[] for _ in texts]
        scores: list[float] = []
        spans: list[list[tuple[int, int]]] = []
        for i in range(0, len(texts), 128):
            some = texts[i : i + 128]
            p, per_text = self.field.tag(some)
            z = self._raw(p, per_text)
            scores += (1 / (1 + np.exp(-np.clip(self.a * z + self.b, -30, 30)))).tolist()
            ends = np.cumsum(per_text).tolist()
            hit = np.append(0, np.cumsum(p >= SPAN))
            for text, end, n in zip(some, ends, per_text.tolist()):
                spans.append(_offsets(text or "", p[end - n : end] >= SPAN) if hit[end] > hit[end - n] else [])
        return scores, spans


def _offsets(text: str, toxic: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    line_of = -1
    at = 0
    places = []
    for line in text.split("\n"):
        line_of += 1
        for m in re.finditer(r"\S+", line):
            places.append((at + m.start(), at + m.end(), line_of))
        at += len(line) + 1
    if len(places) != len(toxic):
        raise ValueError(f"{len(places)} words have places, {len(toxic)} have tags")
    last = None
    for (a, b, line), t in zip(places, toxic.tolist()):
        if t and last == line:
            out[-1] = (out[-1][0], b)
        elif t:
            out.append((a, b))
        last = line if t else None
    return out


def fit_toxicity(documents: DataFrame, labels: DataFrame, limit: int = FIT_DOCS) -> ToxicityModel:
    """Fits on at most `limit` labelled documents, none of them held out; without evidence the score is a constant."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return fitted(training_sample(own, labels, "toxic", MODULUS, HELD_OUT, limit).select("text", "y", "doc_id"), ToxicityModel)


def add_toxicity(spark: SparkSession, documents: DataFrame, model: ToxicityModel, name: str = "toxicity_score", spans: str | None = "toxic_spans") -> DataFrame:
    """documents with the score in column `name` and the spans (character offsets) in column `spans`: no shuffle, whole texts.

    Null and empty texts have no words, the least score that the model gives and no spans; rows that repeat each
    get the same, an empty table stays empty. Other columns pass through; one that has the name of an output is an error.
    """
    if {name.lower(), (spans or name).lower()} & set(map(str.lower, documents.columns)):
        raise ValueError(f"documents have a column {name} or {spans} already")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            scores, found = [], []
            for i in range(0, batch.num_rows, 512):
                s, f = shared.value.score(batch.column("text").slice(i, 512).to_pylist())
                scores += s
                found += [[{"start": a, "stop": b} for a, b in x] for x in f]
            more = [pa.array(found, kind)] if spans else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), *more], [*batch.schema.names, name, *([spans] if spans else [])])

    fields = [*documents.schema.fields, T.StructField(name, T.DoubleType()), *([T.StructField(spans, SPANS)] if spans else [])]
    return streamed(documents, run, T.StructType(fields))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = add_toxicity(spark, docs.select("doc_id", "text"), model, "score", "spans")
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"), F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["stop"])), ",").alias("offsets"))


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
