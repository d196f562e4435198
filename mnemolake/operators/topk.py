"""The best rows of many queries at once, by blocks of numbers inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import scoring as S

#: Numbers of a block of queries by rows at most.
CELLS = 2_000_000


def block_rows(width: int) -> int:
    return max(16, min(1024, CELLS // max(1, width)))


def ids_of(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), object)


class Best:
    """Of what a task has met, the k rows of each of n queries with the least key, ties to the smaller id.

    `floor` is each query's k-th key so far: rows beyond it need not be offered.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k, self.floor, self.held, self.waiting = n, k, np.full(n, np.inf), [], 0

    def offer(self, q: np.ndarray, key: np.ndarray, value: np.ndarray, ids: np.ndarray) -> None:
        if len(q):
            self.held.append((q, key, value, ids))
            self.waiting += len(q)
            if self.waiting >= self.n * self.k:
                self.cut()

    def cut(self) -> None:
        if self.waiting:
            q, key, value, ids = (np.concatenate(x) for x in zip(*self.held))
            order = np.lexsort((ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1], key, q))
            q, key, value, ids = q[order], key[order], value[order], ids[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == self.k - 1
            self.floor[q[last]] = key[last]
            kept = place < self.k
            self.held, self.waiting = [(q[kept], key[kept], value[kept], ids[kept])], 0

    def limits(self, keys: np.ndarray, slack: np.ndarray | float) -> np.ndarray:
        """For each query what its keys (queries by rows) may be at most; slack is what they may differ by from those offered."""
        most = self.floor + slack
        open_ = np.flatnonzero(np.isinf(self.floor))
        if len(open_) and keys.shape[1] > self.k:
            own = np.partition(keys[open_], self.k - 1, axis=1)[:, self.k - 1]
            most[open_] = np.fmin(most[open_], own + 2 * (slack[open_] if isinstance(slack, np.ndarray) else slack))
        return most

    def rows(self, qids: pa.Array, kind: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
        self.cut()
        for q, _, value, ids in self.held:
            for at in range(0, len(q), 65536):
                part = slice(at, at + 65536)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(q[part])), pa.array(ids[part].tolist(), kind), pa.array(value[part])], ["qid", "id", name])


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the vectors of that length, which of the rows they are)."""
    own = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    return np.asarray(column.filter(own).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim), own.to_numpy(zero_copy_only=False)


def offer_nearest(best: Best, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None, some: np.ndarray | None = None) -> None:
    """Offers rows by squared distance to the queries, of which `some` are meant if given; allowed: queries by rows.

    A product of matrices rules out most pairs; the sums of the others run in the order of the components, as in the SQL.
    """
    which = np.arange(len(queries)) if some is None else some
    own = queries if some is None else queries[some]
    if not len(own) or not len(rows):
        return
    with np.errstate(all="ignore"):
        a, b = (own * own).sum(1), (rows * rows).sum(1)
        about = a[:, None] + b - 2 * own @ rows.T
        if allowed is not None:
            about[~allowed] = np.inf
        slack = 1e-12 * (a + b.max())
        most = np.full(len(queries), np.nan)
        part = Best(len(own), best.k)
        part.floor = best.floor[which]
        most = part.limits(about, slack)
        met = ~(about > most[:, None])
        if allowed is not None:
            met &= allowed
        q, r = np.nonzero(met)
        exact = np.zeros(len(q))
        for x, y in zip(np.ascontiguousarray(own.T), np.ascontiguousarray(rows.T)):
            away = y[r] - x[q]
            exact += away * away
    best.offer(which[q], exact, exact, ids[r])


def by_words(qids: pa.Array, asked: list[list[int]], terms: pa.Array, idf: np.ndarray, average: float, k: int) -> Callable:
    """Task code from (id, dl, term, tf), a row's terms one after another, to qid, id, raw: the k best rows of each query by BM25.

    asked: the places of a query's terms in `terms`.
    """
    order = sorted(range(len(asked)), key=lambda i: -len(asked[i]))
    wide = [np.array([asked[i][j] for i in order if len(asked[i]) > j]) for j in range(max(map(len, asked)))]
    places = np.array(order)

    def score(best: Best, ids: np.ndarray, doc: np.ndarray, code: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> None:
        gains = np.zeros((len(terms), len(ids)))
        gains[code, doc] = idf[code] * tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * dl / average))
        raw = np.zeros((len(order), len(ids)))
        for own in wide:
            raw[: len(own)] += gains[own]
        part = Best(len(order), k)
        part.floor = best.floor[places]
        most = part.limits(-raw, 2e-9)
        q, r = np.nonzero((raw >= -most[:, None]) & (raw > 0))
        found = raw[q, r]
        best.offer(places[q], -np.round(found, 9), found, ids[r])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, size, held, kind = Best(len(asked), k), block_rows(max(len(terms), len(asked))), None, None
        for batch in batches:
            kind = batch.schema.field("id").type
            code = pc.index_in(batch.column("term"), value_set=terms)
            own = pc.is_valid(code)
            got = (ids_of(batch.column("id").filter(own)), code.filter(own).to_numpy(), *(batch.column(c).filter(own).to_numpy(zero_copy_only=False).astype(float) for c in ("tf", "dl")))
            held = got if held is None else tuple(np.concatenate(x) for x in zip(held, got))
            held = _whole(held, size, score, best, False)
        if held is not None:
            _whole(held, size, score, best, True)
            yield from best.rows(qids, kind, "raw")

    return run


def _whole(held: tuple, size: int, score: Callable, best: Best, last: bool) -> tuple:
    """Scores the rows that are whole, and gives back the terms of the last one unless no more come."""
    ids, code, tf, dl = held
    if not len(ids):
        return held
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    n = len(starts) if last else len(starts) - 1
    ends = np.append(starts, len(ids))
    for at in range(0, n, size):
        to = min(at + size, n)
        a, b = ends[at], ends[to]
        doc = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
        score(best, ids[starts[at:to]], doc, code[a:b], tf[a:b], dl[a:b])
    return tuple(x[ends[n] :] for x in held)
