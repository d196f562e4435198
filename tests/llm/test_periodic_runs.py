import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemolake.llm import periodic_runs as pr
from mnemolake.llm.common import table

from ..conftest import SF


def plain_runs(w: list, least: int) -> list[tuple[int, int, int]]:
    """Every stretch in which words q apart are equal, for every q, as far as it goes; a stretch counts with its smallest q."""
    codes = np.unique(np.array(w, object).astype(str), return_inverse=True)[1] if w else np.zeros(0, int)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate(([False], codes[q:] == codes[:-q], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1]).tolist()
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s + q >= max(least, 2 * q):
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([2, 3, 4, 7, 12]))
def test_runs_equal_plain_search(w, least):
    assert sorted((s, e - s, p) for (s, e), p in pr.runs_of(w, least).items()) == plain_runs(w, least)
    assert pr.runs_of_text([b"%d" % x for x in w], least) == plain_runs(w, least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 9), min_size=1, max_size=9), st.integers(1, 6)), max_size=8))
def test_runs_of_repeated_parts(parts):
    w = [x for own, times in parts for x in own * times]
    assert pr.runs_of_text([b"%d" % x for x in w]) == plain_runs(w, 12)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=50))
def test_factors_are_the_longest_earlier_ones(w):
    at = 0
    for start, length, source in pr.factors(w):
        assert start == at
        earlier = lambda size: any(w[s : s + size] == w[start : start + size] for s in range(start))  # noqa: B023, E731
        assert source == -1 and not earlier(1) or w[source : source + length] == w[start : start + length] and source < start
        assert start + length == len(w) or length == 1 and source == -1 or not earlier(length + 1)
        at += length
    assert at == len(w)


def test_words_of_fibonacci_and_long_texts():
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    assert sorted((s, e - s, p) for (s, e), p in pr.runs_of(b).items()) == plain_runs(b, 12)
    assert pr.runs_of([5] * 50_000) == {(0, 50_000): 1}
    assert pr.runs_of([*range(1000)] * 60) == {(0, 60_000): 1000}


def test_query_equals_plain_search(spark):
    docs = table(spark, SF, "documents").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, planted = {}, 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        own = plain_runs(w, 12)
        dropped = {i for s, length, q in own for i in range(s + q, s + length)}
        best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want[d.doc_id] = (len(own), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in own)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))
    got = {r.doc_id: tuple(r)[1:] for r in pr.op11_periodic_runs(spark, SF).collect()}
    assert got == want and planted > 5 and sum(v[0] > 0 for v in want.values()) > planted // 2


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a " * 30), (4, "a " * 30), (None, "x y " * 10 + "z"), (5, "x\x1cy \x85 " * 12), (6, "one two"), (7, "ab　c " * 12)]
    frame = spark.createDataFrame([(d, t, 1, "r", "c") for d, t in rows], "doc_id long, text string, n_words long, runs string, collapsed string")
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pr.find_runs(frame).collect())
    assert got == [(0, 21, [(0, 20, 2)], "x y z"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 30, [(0, 30, 1)], "a"), (4, 30, [(0, 30, 1)], "a"), (5, 24, [(0, 24, 2)], "x\x1cy \x85"), (6, 2, [], "one two"), (7, 12, [(0, 12, 1)], "ab　c")]
    assert pr.digests(pr.find_runs(frame.limit(0))).count() == 0
    none = next(r for r in pr.digests(pr.find_runs(frame)).collect() if r.doc_id == 1)
    assert none.n_runs == 0 and none.start is none.length is none.period is none.exponent_milli is None and none.runs_sha256 == none.collapsed_sha256 == hashlib.sha256(b"").hexdigest()
