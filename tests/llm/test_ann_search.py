import numpy as np
import pytest

from mnemolake.llm import ann_search
from mnemolake.llm.common import table

from ..conftest import SF, same_rows


def exact(rows, asked, k):
    """{row number: its k nearest other rows (id, score)} by all cosines, ties to the smaller id."""
    usable = [(i, v) for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in usable:
        if asked(rows[i][0]):
            a = np.array(v, float)
            near = [(-float(a @ np.array(u, float) / np.linalg.norm(a) / np.linalg.norm(u)), rows[j][0]) for j, u in usable if j != i and len(u) == len(v)]
            near.sort(key=lambda x: (round(x[0], 12), x[1] is None, x[1] or 0))
            out[i] = [(d, -s) for s, d in near[:k]]
    return out


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(d, v, 7, "x") for d, v in rows], f"vec_id long, embedding array<{kind}>, rank int, query_id string")


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_recall_of_whole_table_against_all_cosines(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    want = {rows[i][0]: near for i, near in exact(rows, lambda d: d % 50 == 0, 5).items()}
    got = answers(ann_search.op12_ann_search(spark, SF))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({d for d, _ in got[q]} & {d for d, _ in want[q]}) for q in want)
    assert hits >= 0.97 * 5 * len(want)
    same_rows(spark, "op12_ann_search")
    true = {(q, d): s for q, near in want.items() for d, s in near}
    assert all(abs(s - true[q, d]) < 1e-12 for q, near in got.items() for d, s in near if (q, d) in true)


@pytest.mark.parametrize("kind", ["random", "clusters", "copies"])
def test_recall_over_shards(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (3000, 24))
    if kind == "clusters":
        v = rng.normal(0, 1, (6, 24))[rng.integers(0, 6, 3000)] + 0.02 * v
    if kind == "copies":
        v[1000:2000], v[2000:2900] = v[5], v[np.arange(900) % 450 + 6]
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    want = {rows[i][0]: near for i, near in exact(rows, lambda d: d % 50 == 0, 5).items()}
    got = answers(ann_search.neighbours(spark, frame(spark, rows), ann_search.F.col("vec_id") % 50 == 0, shard_rows=700, view=96, block=16))
    assert got.keys() == want.keys()
    hits = sum(len({d for d, _ in got[q]} & {d for d, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)


def test_graph_reaches_all_and_arrays_round_trip():
    rng = np.random.default_rng(1)
    points = ann_search.unit(rng.normal(0, 1, (1500, 16)))
    levels = np.sort(ann_search.levels_of(rng.integers(-(1 << 63), (1 << 63) - 1, 1500)))[::-1]
    layers = ann_search.graph(points, levels)
    assert [len(x) for x in layers] == [int((levels >= i).sum()) for i in range(levels[0] + 1)]
    seen, todo = {0}, [0]
    while todo:
        fresh = {int(x) for n in todo for x in layers[0][n] if x >= 0} - seen
        seen |= fresh
        todo = list(fresh)
    assert len(seen) == 1500
    for links in layers:
        for i, own in enumerate(links.tolist()):
            there = [x for x in own if x >= 0]
            assert i not in there and len(set(there)) == len(there) and max(there, default=0) < len(links)
    back = ann_search.unpacked(np.array([len(x) for x in layers]), np.concatenate([x.ravel() for x in layers]))
    assert all((a == b).all() for a, b in zip(layers, back))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, []), (300, [None, 1.0]), (3, [1.0, 1.0]), (350, [1.0, 0.0, 0.0]), (400, [1e-300, 1e-300]), (450, [0.0, -1e300]), (500, [0.0, 1.0, 0.0])]
    got = answers(ann_search.neighbours(spark, frame(spark, rows, "double"), ann_search.F.col("vec_id") % 50 == 0, k=3))
    assert {q: [d for d, _ in near] for q, near in got.items()} == {0: [1, 2, 2], 350: [500], 500: [350], 400: [3, 0, 1], 450: [0, 1, 2]}
    assert got[400][0][1] == pytest.approx(1) and got[450][0][1] == 0
    twice = answers(ann_search.neighbours(spark, frame(spark, rows[:5], "double"), ann_search.F.col("vec_id") == 0, k=9))
    assert [d for d, _ in twice[0]] == [1, 2, 2, None]
    assert ann_search.neighbours(spark, frame(spark, []), ann_search.F.col("vec_id") % 50 == 0).count() == 0
