"""Packing by powers of two: every sequence is one piece of one document.

A document's ids (with the end token) are cut into pieces whose lengths are powers of two: as many of
``capacity`` as there are, then one piece for each binary digit of the rest, longest first. A
sequence is one piece, so no sequence crosses documents and none needs padding. Pieces of one length form a bucket,
from which training draws batches of one shape (``write_buckets`` lays the ids out so).

Sequences are numbered bucket by bucket, longest first, without gaps. Each task counts its own pieces of each length while it
cuts; what came before in other tasks is added from a table of one row for each task and length. So no bucket, however
large, is sorted or meets in one task, and texts are never shuffled.

Defined results: a null text counts as empty; an empty text is its end token alone, a piece of length one; rows with null or repeated ids are
documents of their own, each with its own sequences; a long text is cut into as many pieces as it needs; an empty table gives no
rows; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import settle, table, text_of
from heddle.llm.tokens import encoder

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
END = 1

PIECES = (
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("task", pa.int32()), ("place", pa.int64()), ("ids", pa.binary()),
)
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of ``n`` ids, in their order; ``capacity`` is a power of two."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END,
    keep_ids: bool = False, text_col: str = "text",
) -> DataFrame:
    """One row per piece; ``place`` counts the pieces of that length that the task ``task`` has cut before.

    With ``keep_ids`` each piece has its ids (u32, little-endian). To be settled before it is read twice.
    """
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")
    fields = PIECES if keep_ids else PIECES[:-1]

    def cut(batches):
        tokens, task = encoder(vocabulary), TaskContext.get().partitionId()
        tail = np.array([end], "<u4").tobytes()
        seen = dict.fromkeys((1 << k for k in range(capacity.bit_length())), 0)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), tokens.encode(batch["text"].to_pylist()), strict=True):
                ids += tail
                n, at = len(ids) // 4, 0
                for size in lengths(n, capacity):
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append((doc, at, size, zlib.crc32(part), n, task, seen[size]) + (part,) * keep_ids)
                    seen[size] += 1
                    at += size
            columns = zip(*rows, strict=True) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[name for name, _ in fields]
            )

    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return named.mapInArrow(cut, ", ".join(f"{name} {_SQL[t]}" for name, t in fields))


def number(cut: DataFrame) -> DataFrame:
    """``cut`` (settled pieces) with ``sequence_id`` and ``offset``, without ``task`` and ``place``."""
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    # One row for each task and length: lengths are few, so tasks are added up in blocks first.
    block = F.floor(F.col("task") / 1024)
    counts = settle(counts.withColumn("block", block))
    blocks = counts.groupBy("length", "block").agg(F.sum("n").alias("n"))
    order = Window.orderBy(F.desc("length"), "block")  # some ten rows for each 1,024 tasks
    blocks = blocks.select("length", "block", (F.sum("n").over(order) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "block").orderBy("task")
    firsts = counts.withColumn("inside", F.sum("n").over(within) - F.col("n")).join(blocks, ["length", "block"])
    firsts = firsts.select("task", "length", (F.col("before") + F.col("inside")).alias("first"))
    numbered = cut.join(firsts, ["task", "length"])
    names = [c for c in cut.columns if c not in ("task", "place")]
    return numbered.select(*names, (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def pack(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece (and ``ids``)."""
    return number(settle(pieces(docs, capacity, keep_ids=keep_ids, text_col=text_col)))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write packed sequences (with ``ids``) to a new folder ``path``, one folder ``bucket=<length>`` for each length.

    Within a file, sequences are in order. Large buckets are dealt out to many files.
    """
    bucketed = packed.withColumn("bucket", F.col("length"))
    spread = bucketed.repartition("bucket", F.pmod(F.col("sequence_id"), F.lit(64)))
    spread.sortWithinPartitions("bucket", "sequence_id").write.partitionBy("bucket").parquet(path)


def op13_power_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
