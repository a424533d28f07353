"""Periodic runs: stretches of words that repeat with a period, found on a harmonic grid.

A run of period p and two periods or more holds two neighbouring points of the grid 0, p, 2p, ... So it is enough to
look at all pairs (p, grid point), n/1 + n/2 + n/3 + ... of them. Each pair's
longest common extensions, forwards and backwards, come from binary search over prefix hashes, for all pairs of a
text at once. What the hashes say is verified on the words themselves (a period for which they were wrong is
scanned word by word). A stretch found for several periods or from several grid points is one
run, with the least of them: by Fine and Wilf that is its smallest period, as each multiple finds the same stretch.

Every text is judged where it is read: no row is shuffled. Pairs are taken in slices of ``SLICE``, so memory grows with the
text's words, not with their pairs.

Defined results: a null or empty text has no words and no run; a long text is read whole; repeated rows and rows with null or equal
ids are each judged on their own; an empty table gives no rows; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heddle.llm.common import table, text_of

#: A run has so many words at least, and two periods.
LEAST = 12
#: Pairs of period and grid point that are looked at together.
SLICE = 1 << 20
#: Stretches of so many words or more are not looked at again for multiples of their period.
LONG = 1024

_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


def _value(code: np.ndarray) -> np.ndarray:
    """A random-looking value for each word number."""
    x = (code.astype("u8") + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Extensions:
    """Longest common extensions of pairs of places of one word sequence."""

    def __init__(self, code: np.ndarray):
        self.code, self.n = code, len(code)
        self.power = _powers(1 << max(10, self.n.bit_length()))
        self.prefix = np.zeros(self.n + 1, "u8")
        np.cumsum(_value(code) * self.power[: self.n], out=self.prefix[1:])

    def _equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from ``a`` hash like those from ``b`` (b >= a)."""
        prefix = self.prefix
        return (prefix[a + size] - prefix[a]) * self.power[b - a] == prefix[b + size] - prefix[b]

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from ``a`` and ``b`` (b > a) on."""
        return self._search(self.n - b, lambda at, size: self._equal(a[at], b[at], size))

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree before ``a`` and ``b`` (b > a)."""
        return self._search(a.copy(), lambda at, size: self._equal(a[at] - size, b[at] - size, size))

    @staticmethod
    def _search(high: np.ndarray, equal: Callable) -> np.ndarray:
        low = np.zeros(len(high), "i8")
        open_ = np.flatnonzero(low < high)
        step = 1
        while len(open_):  # doubling steps: most extensions are short
            size = np.minimum(low[open_] + step, high[open_])
            same = equal(open_, size)
            low[open_[same]] = size[same]
            high[open_[~same]] = size[~same] - 1
            open_ = open_[same & (size < high[open_])]
            step *= 2
        open_ = np.flatnonzero(low < high)
        while len(open_):
            size = (low[open_] + high[open_] + 1) >> 1
            same = equal(open_, size)
            low[open_[same]] = size[same]
            high[open_[~same]] = size[~same] - 1
            open_ = open_[low[open_] < high[open_]]
        return low


def _grid(n: int, slice_: int = SLICE):
    """All pairs (period, grid point) with both points in the sequence, in slices."""
    periods = np.arange(1, n // 2 + 1)
    counts = (n - 1 - periods) // periods + 1
    ends = np.cumsum(counts)
    first = 0
    while first < len(periods):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + slice_, "right")))
        c = counts[first:last]
        p = np.repeat(periods[first:last], c)
        k = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
        yield p, p * k
        first = last


def find_runs(code: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of the word numbers ``code``, by start, then period."""
    n, found, doubtful = len(code), {}, set()
    reach = None
    for p, a in _grid(n) if n >= least else ():
        like = code[a] == code[a + p]
        # Multiples of a long stretch's period find that stretch again at each of its points.
        for (s, e), q in sorted(((x, q) for x, q in found.items() if x[1] - x[0] >= LONG), key=lambda r: r[0][0] - r[0][1])[:16]:
            like &= (p % q > 0) | (a < s) | (a + p >= e)
        p, a = p[like], a[like]
        if not len(p):
            continue
        reach = reach or Extensions(code)
        ahead, back = reach.forward(a, a + p), reach.backward(a, a + p)
        enough = ahead + back + p >= np.maximum(least, 2 * p)
        p, start, end = p[enough], (a - back)[enough], (a + p + ahead)[enough]
        for q, s, e in np.unique(np.stack([p, start, end], 1), axis=0).tolist():  # least periods first
            known = found.get((s, e))
            if known is not None and q % known == 0:  # a multiple finds the same stretch
                continue
            if not _holds(code, s, e, q):
                doubtful.add(q)
            elif known is None:
                found[s, e] = q
    for q in doubtful:
        for s, e in _scan(code, q, least):
            found[s, e] = min(q, found.get((s, e), q))
    if not found:
        return np.zeros((0, 3), "i8")
    rows = np.array([(s, e - s, q) for (s, e), q in found.items()], "i8")
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _holds(code: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether the words of a stretch have the period and no neighbour extends it."""
    before = start > 0 and code[start - 1] == code[start - 1 + period]
    after = end < len(code) and code[end] == code[end - period]
    return not before and not after and bool((code[start : end - period] == code[start + period : end]).all())


def _scan(code: np.ndarray, period: int, least: int) -> list[tuple[int, int]]:
    """All stretches (start, end) of one period, word by word."""
    same = np.concatenate([[0], (code[:-period] == code[period:]).view("i1"), [0]])
    edges = np.flatnonzero(np.diff(same)).reshape(-1, 2).tolist()
    return [(a, b + period) for a, b in edges if b - a + period >= max(least, 2 * period)]


def repeated(n: int, rows: np.ndarray) -> np.ndarray:
    """For each of ``n`` words whether some run holds it after the run's first period."""
    change = np.zeros(n + 1, "i8")
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def detect(
    docs: DataFrame, least: int = LEAST, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
    keep: bool = False, text_col: str = "text",
) -> DataFrame:
    """Per row the number of runs, the longest one (ties: least start, then period) and digests of all runs and of the words left.

    ``prepare(doc_id, words)`` may change the words (UTF-8) before they are judged. With ``keep`` there are also ``runs`` (array of
    start, length, period) and ``collapsed``, the text without repeated periods.
    """
    more = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if keep else ""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [run_type, pa.string()] * keep
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["runs", "collapsed"] * keep

    def judge(doc: int | None, text: str) -> tuple:
        words = text.encode().split()  # bytes: splits at ASCII white space
        if prepare is not None:
            words = prepare(doc, words)
        code = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()
        rows = find_runs(code, least)
        left = words
        top = (None,) * 4
        if len(rows):
            gone = repeated(len(words), rows).tolist()
            left = [w for w, x in zip(words, gone, strict=True) if not x]
            start, length, period = rows[np.lexsort((rows[:, 2], rows[:, 0], -rows[:, 1]))[0]].tolist()
            top = (start, length, period, 1000 * length // period)
        listed = "".join("%d,%d,%d\n" % tuple(r) for r in rows.tolist())
        kept = b" ".join(left)
        out = (doc, len(rows), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        return out + ([dict(zip(("start", "length", "period"), r, strict=True)) for r in rows.tolist()], kept.decode()) * keep

    def run(batches):
        for batch in batches:
            rows = [judge(*x) for x in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return named.mapInArrow(run, SCHEMA + more)


def plant(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The query's change of its input: about a tenth of the texts get a periodic tail, by their id. A null id changes nothing."""
    n = len(words)
    if doc is None or not n:
        return words
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), prepare=plant)
