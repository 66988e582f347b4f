"""The best k of many rows for each of some queries, kept in a bounded place while the rows stream by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a score matrix that a task holds at a time.
CELLS = 4 << 20


class Best:
    """The k best rows of each query: greatest score first, ties by the smallest place (or the greatest: last_place).

    A row that can't be among them any more is dropped as it comes; what is held is at most a few times queries x k rows.
    """

    def __init__(self, queries: int, k: int, *, last_place: bool = False) -> None:
        self.k, self.last = k, last_place
        self.least = np.full(queries, -np.inf)  # the k-th best score of each query, -inf until there are k
        self.place = np.empty(queries, object)  # and its place
        self.held: pa.Table | None = None
        self.new: list[pa.Table] = []
        self.rows = 0
        self.most = max(2 * queries * k, CELLS // 16)

    def mask(self, scores: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which cells (row, query) may still be among the best; NaN never is. A column without a bound takes its own k-th best for one."""
        bound = self.least
        if len(scores) > self.k and (open_ := np.isneginf(bound)).any():
            bound = bound.copy()
            bound[open_] = np.partition(np.nan_to_num(scores[:, open_], nan=-np.inf), -self.k, axis=0)[-self.k]
        fine = scores >= bound
        fine &= ~np.isneginf(scores)
        for q in np.flatnonzero(~np.isneginf(self.least) & (scores == self.least).any(axis=0)):  # ties count only before the last place
            tied = np.flatnonzero(scores[:, q] == self.least[q])
            fine[tied, q] = (places[tied] > self.place[q]) if self.last else (places[tied] < self.place[q])
        return fine

    def add(self, queries: np.ndarray, scores: np.ndarray, rows: pa.Table) -> None:
        """rows: with a column `place`, a row for each of the queries and scores."""
        if len(queries):
            self.new.append(rows.append_column("q", pa.array(queries, pa.int32())).append_column("score", pa.array(scores, pa.float64())))
            self.rows += len(queries)
            if self.rows > self.most:
                self.shrink()

    def shrink(self) -> None:
        if not self.new:
            return
        every = pa.concat_tables([*([self.held] if self.held else []), *self.new])
        every = every.take(pc.sort_indices(every, [("q", "ascending"), ("score", "descending"), ("place", "descending" if self.last else "ascending")]))
        q = every["q"].to_numpy()
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        self.held, self.new, self.rows = every.filter(pa.array(rank < self.k)), [], 0
        ends = every.filter(pa.array(rank == self.k - 1))
        at = ends["q"].to_numpy()
        self.least[at], self.place[at] = ends["score"].to_numpy(), ends["place"].to_pylist()

    def result(self) -> pa.Table | None:
        """What is held: with q and score; None if nothing is."""
        self.shrink()
        return self.held
