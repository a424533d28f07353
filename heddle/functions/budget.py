"""A table function for SQL: greedy batches along each partition's rows, which no window frame can express.

``SELECT * FROM heddle_batches(TABLE(SELECT user_id, event_id, cents FROM t) PARTITION BY user_id ORDER BY (ts, event_id), 5000)``

A batch takes rows in order as long as their weights fit the budget; the row that doesn't fit starts the next one, and a row over the budget is
a batch of its own. The function gets Arrow batches of a partition and keeps five numbers between them, so a partition of any
length runs in bounded memory, but in one task: partition by keys that are fine enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

NAME = "heddle_batches"


def greedy(weights: np.ndarray, budget: int, held: int) -> np.ndarray:
    """Which rows start a batch; ``held``: the open batch's weight (-1: none is open).

    Jumps from batch to batch by binary search in the running sums, so the steps are those of batches, not of rows.
    """
    sums = np.cumsum(weights)
    starts, at = [], 0
    if held >= 0:
        at = int(np.searchsorted(sums, budget - held, "right"))
    while at < len(weights):
        starts.append(at)
        before = sums[at - 1] if at else 0
        at = max(at + 1, int(np.searchsorted(sums, before + budget, "right")))
    return np.array(starts, "i8")


@arrow_udtf(returnType="key long, batch long, first_id long, n long, weight long")
class Batches:
    """Input columns: key, id, weight (whole numbers, not below zero; null: zero). Rows out: each batch with its first row's id."""

    def __init__(self):
        self.key = self.first = None
        self.batch, self.n, self.weight = 0, 0, -1

    def eval(self, rows: pa.RecordBatch, budget: pa.Array) -> Iterator[pa.Table]:
        if not rows.num_rows:
            return
        ids, out = rows.column(1), []
        weights = rows.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
        starts = greedy(weights, budget[0].as_py(), self.weight)
        sums = np.concatenate([[0], np.cumsum(weights)])
        self.key = rows.column(0)[0].as_py()
        first = int(starts[0]) if len(starts) else len(weights)
        self.n += first  # these still fit the open batch
        self.weight += int(sums[first])
        for a, b in zip(starts.tolist(), [*starts.tolist(), len(weights)][1:], strict=True):
            if self.n:
                out.append((self.key, self.batch, self.first, self.n, self.weight))
            self.batch, self.first, self.n, self.weight = self.batch + 1, ids[a].as_py(), b - a, int(sums[b] - sums[a])
        if out:
            yield self._table(out)

    def terminate(self) -> Iterator[pa.Table]:
        if self.n:
            yield self._table([(self.key, self.batch, self.first, self.n, self.weight)])

    @staticmethod
    def _table(rows: list[tuple]) -> pa.Table:
        names = ("key", "batch", "first_id", "n", "weight")
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(names, zip(*rows, strict=True), strict=True)})


def register(spark: SparkSession) -> None:
    spark.udtf.register(NAME, Batches)
