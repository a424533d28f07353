"""Best-fit decreasing packing of token sequences, global and exact, planned from a histogram.

Lengths are whole numbers up to the capacity, so all pieces of one length are alike and all
open bins with one remaining capacity are alike. The plan therefore needs only the number of
pieces of each length (at most ``capacity`` rows, however large the corpus). It walks the lengths
downwards and asks a segment tree over the remaining capacities for the tightest one with an
open bin, in logarithmic time; a run of alike bins takes a run of alike pieces at once. The
outcome is what placing the pieces one by one gives. Spark then ranks the pieces of each length
(in buckets, so that a length held by a third of all pieces is spread out) and each
piece finds its place by its length and rank.

Defined results: a null text counts as empty; an empty text is its end token alone; rows with null
or repeated ids are pieces of their own; a long text is cut into as many pieces as it needs; an empty table gives no rows; other
columns, whatever their names, are dropped.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import settle, table, text_of
from heddle.llm.tokens import encoder

CAPACITY = 1024
VOCABULARY = "byte_bpe_50k.json"
END = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END,
    keep_ids: bool = False, text_col: str = "text",
) -> DataFrame:
    """One row per piece of each document; with ``keep_ids`` the ids themselves too (u32, little-endian).

    A document over ``capacity`` is cut so that only its first piece can be shorter.
    """
    schema = PIECES + (", ids binary" if keep_ids else "")

    def cut(batches):
        tokens = encoder(vocabulary)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), tokens.encode(batch["text"].to_pylist()), strict=True):
                ids += tail
                n = len(ids) // 4
                edges = [0, *range(n % capacity or min(capacity, n), n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(part)) + ((part,) if keep_ids else ()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
            names = [x.split()[0] for x in schema.split(", ")]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return named.mapInArrow(cut, schema)


class Remaining:
    """Segment tree over remaining capacities: counts of open bins, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.size
        while at:
            self.open[at] += bins
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open bin has left."""
        at = least + self.size
        while not self.open[at]:
            while at & 1:  # a right child: nothing more beside it under this parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at + (not self.open[2 * at])
        return at - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first bin, offset): ranks and bins run in step from their firsts."""
    tree, runs = Remaining(capacity), {r: deque() for r in range(capacity + 1)}
    rows, bins = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, have = bins, -(-left // each)
                bins += have
            else:
                each = room // length
                first, have = runs[room].popleft()
                tree.add(room, -have)
            for took, n in ((each, min(have, left // each)), (left % each, 1)):
                if not (took and n and have and left >= took):
                    continue
                for k in range(took):
                    rows.append((length, rank, n, first, capacity - room + k * length))
                    rank += n
                left -= took * n
                rest = room - took * length
                if rest:
                    runs[rest].append((first, n))
                    tree.add(rest, n)
                first, have = first + n, have - n
                if left >= each:  # more alike pieces than this run holds
                    break
            if have:
                runs[room].appendleft((first, have))
                tree.add(room, have)
    return rows


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (with ``doc_id``, ``piece``, ``length``) with ``sequence_id`` and ``offset``.

    ``rows`` is read three times, so it should be a settled table. Lengths are 1 to ``capacity``.
    """
    lengths = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = pd.DataFrame(plan(lengths, capacity), columns=["length", "rank", "n", "bin", "offset"])
    buckets = max(64, sum(lengths.values()) // 1_000_000)
    spread = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", *_rest(rows)), F.lit(buckets)))
    sizes = spread.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(
        F.col("length").alias("_length"), F.col("_bucket").alias("_b"),
        (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"),
    )
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", *_rest(rows)))
    ranked = spread.withColumn("_rank", within - 1).join(
        before, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_b"))
    )
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_length", "_b", "_before", "_bucket")
    # The plan is bounded by the capacity, not by the corpus.
    starts = (steps["length"].to_numpy() << 44) + steps["rank"].to_numpy() if len(steps) else np.zeros(0, "i8")
    columns = {k: steps[k].to_numpy() for k in ("rank", "bin", "offset")}

    def find(batches):
        for pdf in batches:
            at = np.searchsorted(starts, (pdf["length"].to_numpy() << 44) + pdf["_rank"].to_numpy(), "right") - 1
            pdf["sequence_id"] = columns["bin"][at] + pdf.pop("_rank").to_numpy() - columns["rank"][at]
            pdf["offset"] = columns["offset"][at]
            yield pdf

    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    columns = {k: v[order] for k, v in columns.items()}
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ranked.select(*rows.columns, "_rank").mapInPandas(find, f"{fields}, sequence_id long, offset long")


def _rest(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("doc_id", "piece", "length")]


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from placed pieces with ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "piece")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"])).alias("parts"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    return place(settle(pieces(docs, capacity, keep_ids=keep_ids)), capacity)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
