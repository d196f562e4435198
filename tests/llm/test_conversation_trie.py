import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from mnemolake.llm import conversation_trie as ct
from mnemolake.llm.common import table

from ..conftest import SF, same_rows

SCHEMA = "conv_id long, turn long, role string, text string, depth long, node string"


def plain_trie(rows):
    """{(conv_id, depth): other columns} from the contract's words."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[q] for q in children[p]]
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        sums[p] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + saved)
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(built) if built[c] == p).encode()).hexdigest() for p in members}
    return {(members[p][0], len(p)): (members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), *sums[p], ends[p]) for p in members}


def got(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "n") for r in rows], SCHEMA)
    out = [tuple(r) for r in ct.prefix_trie(spark, frame).select(*ct.NODES).collect()]
    assert len(out) == len({r[:2] for r in out})
    return {r[:2]: r[2:] for r in out}


def test_query_equals_sql_and_plain_trie(spark):
    same_rows(spark, "op13_conversation_trie")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, SF, "conversations").collect()]
    out = {(r.conv_id, r.depth): tuple(r[c] for c in ct.NODES[2:]) for r in ct.op13_conversation_trie(spark, SF).collect()}
    assert out == plain_trie(rows)


@pytest.mark.parametrize("seed", [1])
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 450), 260):
        like = rng.choice([c, c, rng.randrange(5)])
        for t in range(rng.choice([0, 1, 3, 6, 9])):
            rows.append((c, rng.choice([t, t, None]) if t == 0 else t, rng.choice(["user", "user", None]), rng.choice([f"say {like} {t}", "the same", "", None, "ü€𝄞"])))
    assert got(spark, rows) == plain_trie(rows)


def test_long_conversations_and_paths_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ct.scan, "__defaults__", (False, 4))
    rows = [(100 + c, t, "u", f"{t}" if t < 37 - c else f"{c} {t}") for c in range(12) for t in range(40)] + [(300, t, "u", "a" * (t % 7)) for t in range(200)] + [(301, t, "u", "a" * (t % 7)) for t in range(199)]
    assert got(spark, rows) == plain_trie(rows)


def test_many_equal_conversations_and_edges(spark, monkeypatch):
    monkeypatch.setattr(ct, "hot", lambda rows: 20)
    monkeypatch.setattr(ct, "PIECE", 7)
    rows = [(c, t, "u", f"line {t}") for c in range(300) for t in range(7)] + [(c, 0, None, None) for c in range(300, 340)] + [(None, 1, "u", "no conversation")]
    assert got(spark, rows) == plain_trie(rows)
    assert got(spark, []) == {}
    turnless = next(c for c in range(501, 600) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert got(spark, [(turnless, 0, "u", "gone")]) == {(turnless, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())}
    twice = [(600, 1, "u", "again"), (600, 1, "u", "again"), (600, None, "u", "first")]
    assert got(spark, twice) == plain_trie(twice)
