"""The k best rows of many questions, kept while blocks of scores go by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a block, scores that a product makes at once, and candidates that wait for the next sort.
ROWS, CELLS, WAITING = 16_384, 1_000_000, 2_000_000
#: Bytes of the questions that a task has at once: it keeps k rows for each of them.
ASKED_BYTES = 12 << 20
#: Rounding of one operation in single precision.
UNIT = 2.0**-24


def tasks(spark, rows: int) -> int:
    """Tasks that share ``rows``: each hands on its own best, so there are no more than whole blocks, or one for each core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


def kth(block: np.ndarray, k: int) -> np.ndarray:
    """For each row of ``block`` a bound that k of its numbers reach: the k-th best of the maxima of groups."""
    n = block.shape[1]
    size = max(1, min(64, n // (8 * k)))
    groups = n // size
    if groups < k:
        return np.full(len(block), -np.inf)
    most = block[:, : size * groups].reshape(len(block), size, groups).max(axis=1)
    return np.partition(most, groups - k, axis=1)[:, groups - k].astype(np.float64)


class Best:
    """The k best (score, id) of each question among the rows seen so far, ties by id.

    Scores are rounded before they are compared. A row that ties with the last
    one kept is held until the sort, so the result is that of a sort of all.
    """

    def __init__(self, n: int, k: int, digits: int, positive: bool = False):
        self.n, self.k, self.unit = n, k, 10.0**digits
        self.low = np.full(n, 1 / self.unit if positive else -np.inf)
        self.near = 1.01 / self.unit  # what rounding may move
        self.kept: pa.Table | None = None
        self.new: list[pa.Table] = []

    def begin(self, ids: pa.Array) -> None:
        """``ids`` are those of the next block's rows."""
        self.ids, self.found = ids, []
        self.order = np.empty(len(ids), np.int64)
        self.order[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))

    def add(self, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> None:
        """Scores of questions ``q`` and rows ``r`` of the block; a question's rows of a block come in one call."""
        s = np.floor(s * self.unit + 0.5) / self.unit
        held = s >= self.low[q]
        q, r, s = q[held], r[held], s[held]
        order = np.lexsort((self.order[r], -s, q))
        q, r, s = q[order], r[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        last = place == self.k - 1
        self.low[q[last]] = s[last]
        first = place < self.k
        self.found.append((q[first].astype(np.int32), r[first].astype(np.int32), s[first]))

    def end(self) -> None:
        """The block is over."""
        if self.found:
            q, r, s = (np.concatenate(x) for x in zip(*self.found))
            self.new.append(pa.table({"q": q, "s": s, "id": self.ids.take(pa.array(r))}))
        if self.kept is not None and sum(t.num_rows for t in self.new) > WAITING:
            self.sort()
        elif self.kept is None and len(self.new) == 1:
            self.kept, self.new = self.new[0], []  # a block's rows are the best of it already

    def sort(self) -> pa.Table | None:
        """(q, s, id) of the best so far."""
        if self.new:
            found = pa.concat_tables([*([self.kept] if self.kept is not None else []), *self.new])
            found = found.take(pc.sort_indices(found, sort_keys=[("q", "ascending"), ("s", "descending"), ("id", "ascending")]))
            q = found["q"].to_numpy()
            place = np.arange(len(q)) - np.searchsorted(q, q, "left")
            last = place == self.k - 1
            self.low[q[last]] = found["s"].to_numpy()[last]
            self.kept, self.new = found.filter(pa.array(place < self.k)).combine_chunks(), []
        return self.kept


def blocks(parts: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """The batches as tables of about ``rows`` rows."""
    held, n = [], 0
    for batch in parts:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            if n and n + piece.num_rows > rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(piece)
            n += piece.num_rows
    if n:
        yield pa.Table.from_batches(held)
