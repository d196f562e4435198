"""Whole queries of the trained operators and the pipeline against plain, slow versions."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemolake.llm import common, decontamination, quality, toxicity

from ..conftest import SF

TOXIC_SF = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents").orderBy("doc_id").collect()


@pytest.fixture(scope="module")
def labels(spark):
    return common.table(spark, SF, "labels")


def plain_quality(model, text, n_chars):
    """The machine's sum over all pairs of features, one pair at a time for each factor."""
    words = (text or "").split()
    counts = Counter(quality.bucket(w.lower()) for w in words)
    weight = {b: math.log1p(c) for b, c in counts.items()}
    norm = max(1e-12, math.sqrt(sum(w * w for w in weight.values())))
    stats = (np.array(quality.statistics(text or "", words, n_chars)) - model.mean) / model.scale
    x = [(b, w / norm) for b, w in sorted(weight.items())] + [(quality.BUCKETS + i, min(4.0, max(-4.0, s))) for i, s in enumerate(stats.tolist())]
    m, v = model.machine, np.array([model.machine.v[i] * a for i, a in x])
    pairs = sum(float(v[i] @ v[j]) for i in range(len(x)) for j in range(i)) if len(x) < 60 else float(np.tril(v @ v.T, -1).sum())
    z = m.w0 + sum(m.w[i] * a for i, a in x) + pairs
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, model.a * z + model.b))))


def test_quality_query_equals_sums_over_pairs(spark, docs, labels):
    model = quality.fit_quality(common.table(spark, SF, "documents"), labels)
    got = {r.doc_id: r for r in quality.op4_quality(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want = plain_quality(model, d.text, d.n_chars)
        r = got[d.doc_id]
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(want >= 0.7) and r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)


def plain_marginals(pots, trans):
    """P(tag 1) of each word of a line: over all taggings if they are few, else by sums of logarithms in both directions."""
    n = len(pots)
    if n <= 8:
        weight = {t: math.exp(sum(p for p, y in zip(pots, t) if y) + sum(trans[a][b] for a, b in zip(t, t[1:]))) for t in product((0, 1), repeat=n)}
        total = sum(weight.values())
        return [sum(w for t, w in weight.items() if t[i]) / total for i in range(n)]
    emit = [[0.0, p] for p in pots]
    up, down = [emit[0]], [[0.0, 0.0]]
    for i in range(1, n):
        up.append([emit[i][y] + np.logaddexp(up[-1][0] + trans[0][y], up[-1][1] + trans[1][y]) for y in (0, 1)])
    for i in range(n - 1, 0, -1):
        down.append([np.logaddexp(trans[y][0] + emit[i][0] + down[-1][0], trans[y][1] + emit[i][1] + down[-1][1]) for y in (0, 1)])
    return [1 / (1 + math.exp(min(700.0, (a[0] + b[0]) - (a[1] + b[1])))) for a, b in zip(up, reversed(down))]


def plain_toxicity(model, text):
    """(score, offsets of spans)"""
    at, worst, spans = 0, -20.0, []
    for line in (text or "").split("\n"):
        words = list(re.finditer(r"\S+", line))
        if words:
            pots = [float(np.clip(model.field.bias + sum(model.field.theta[toxicity._hash(p) % toxicity.BUCKETS] for p in toxicity.parts_of(w[0])), -40, 40)) for w in words]
            p = [min(1 - 1e-9, max(1e-9, x)) for x in plain_marginals(pots, model.field.trans.tolist())]
            worst = max(math.log(x / (1 - x)) for x in p) if worst == -20.0 else max(worst, *(math.log(x / (1 - x)) for x in p))
            open_ = False
            for w, x in zip(words, p):
                if x >= toxicity.SPAN:
                    spans = [*spans[:-1], (spans[-1][0], at + w.end())] if open_ else [*spans, (at + w.start(), at + w.end())]
                open_ = x >= toxicity.SPAN
        at += len(line) + 1
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, model.a * worst + model.b)))), spans


def test_toxicity_query_equals_sums_over_taggings(spark):
    """On the table that holds evidence enough for a field."""
    table = common.table(spark, TOXIC_SF, "documents")
    model = toxicity.fit_toxicity(table, common.table(spark, TOXIC_SF, "labels"))
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, TOXIC_SF).collect()}
    rows = table.collect()
    assert model.constant is None and len(got) == len(rows)
    for d in rows:
        score, spans = plain_toxicity(model, d.text)
        r = got[d.doc_id]
        assert r.score == pytest.approx(score, abs=1e-6) and r.predicted == int(score >= 0.5) and r.offsets == ",".join(f"{a}-{b}" for a, b in spans), d.doc_id
    assert sum(r.n_spans > 0 for r in got.values()) > 20


def test_pipeline_equals_plain_stages(spark, docs, labels):
    """Every document and every piece of the packed result from plain versions of all five stages."""
    import corpus_pipeline

    table = common.table(spark, SF, "documents")
    model = quality.fit_quality(table, labels)
    kept = [d for d in docs if plain_quality(model, d.text, d.n_chars) >= quality.KEEP]
    mild = toxicity.fit_toxicity(spark.createDataFrame(kept, table.schema), labels)
    kept = [d for d in kept if plain_toxicity(mild, d.text)[0] < toxicity.TOXIC] if mild.constant is None else [d for d in kept if mild.constant < toxicity.TOXIC]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = [split(d.text) for d in kept]
    from mnemolake.llm import ngram_join

    sets = [set(ngram_join.shingles(d.text).tolist()) for d in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    words = [w for i, w in enumerate(words) if group[i] == i]
    kept = [d for i, d in enumerate(kept) if group[i] == i]
    windows = set()
    for item in common.table(spark, SF, "benchmark").collect():
        w = split(item.text)
        n = min(decontamination.WINDOW, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    kept = [d for d, w in zip(kept, words) if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d.doc_id: [*library.encode(d.text or "", add_special_tokens=False).ids, 0] for d in kept}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(ids) < len(docs) and {r.doc_id for r in rows} == set(ids)
    starts, used = defaultdict(list), defaultdict(list)
    for r in rows:
        raw = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.length > 0 and r.ids_crc32 == zlib.crc32(raw) and r.doc_tokens == len(ids[r.doc_id])
        starts[r.doc_id].append((r.start, r.length))
        used[r.sequence_id].append((r.offset, r.length))
    for parts, most in [*((p, len(ids[d])) for d, p in starts.items()), *((p, None) for p in used.values())]:
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == most if most else at <= 1024
    assert len(used) <= math.ceil(sum(map(len, ids.values())) / 1024 * 1.1) + 1
