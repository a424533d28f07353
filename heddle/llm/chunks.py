"""Substring dedup by content-defined chunks.

A gear hash rolls over each text's bytes: every step shifts it by one and adds a byte's random
value, so it depends on the last 16 bytes alone. A chunk ends where the hash's top bits are zero (not
before ``SMALLEST`` bytes, and at ``LARGEST`` at the latest), so the same passage falls into the same chunks
wherever it stands, whatever is inserted before it. Chunks are compared by 128-bit digest.

Single chunks of a few words are common in any language, so they are not compared alone. What is compared are windows of
neighbouring chunks: from each chunk on the shortest that has ``RUN`` bytes, and up to each chunk's end the shortest that has so many. A window that
occurs more than once is a repeated passage; the occurrence in the least document (by id, digest and place) is the first. Bytes
of windows that are not first are removed, but for those that also lie in a window that is. So all that goes stands elsewhere as a string of
``RUN`` bytes or more. A passage's edges lie within chunks that differ, so some 30 bytes at its start and 15 at its end are not seen as repeated.

All windows are counted by digest alone; places follow for those found again, and texts move once, at the end.

Defined results: null and empty texts have no chunks, texts under ``RUN`` bytes no windows; a long text is cut whole; rows that repeat wholly (id and text) are one document and give
equal rows (its windows count once for each row); equal or null ids with other texts are documents of their own (a null id is least); an empty
table gives no rows; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import passing, settle, table, text_of

SMALLEST = 16
LARGEST = 256
MASK_BITS = 4
RUN = 160

WINDOWS = "doc_id long, digest binary, window binary, start long, size long"


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.default_rng(20240502).integers(0, 1 << 16, 256, dtype="u2")


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash after each byte: sum of value(byte i - j) << j, in 16 bits, by doubling."""
    h = _gear()[np.frombuffer(data, "u1")]
    for k in (1, 2, 4, 8):
        more = h.copy()
        more[k:] += h[:-k] << np.uint16(k)
        h = more
    return h


def cuts(data: bytes, smallest: int = SMALLEST, largest: int = LARGEST, bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks of ``data``."""
    ends, at = [], 0
    for c in (np.flatnonzero(gear_hashes(data) >> np.uint16(16 - bits) == 0) + 1).tolist() if data else []:
        while c - at > largest:
            at += largest
            ends.append(at)
        if c - at >= smallest:
            at = c
            ends.append(c)
    while len(data) - at > largest:
        at += largest
        ends.append(at)
    if at < len(data):
        ends.append(len(data))
    return ends


def spans(data: bytes, run: int = RUN) -> np.ndarray:
    """Rows (start, end) of the windows of ``data``: from each chunk on, and up to each chunk's end, the shortest of ``run`` bytes."""
    if len(data) < run:
        return np.zeros((0, 2), "i8")
    ends = np.array(cuts(data), "i8")
    starts = np.concatenate([[0], ends[:-1]])
    to = np.searchsorted(ends, starts + run)
    back = np.searchsorted(starts, ends - run, "right") - 1
    on, up = to < len(ends), back >= 0
    pairs = np.concatenate([np.stack([starts[on], ends[to[on]]], 1), np.stack([starts[back[up]], ends[up]], 1)])
    return np.unique(pairs, axis=0)


def windows(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``doc_id, digest, window, start, size`` for every window of every row."""

    def cut(batches):
        import xxhash

        hashed = xxhash.xxh3_128_digest
        for batch in batches:
            ids, digests, found, places = [], [], [], [np.zeros((0, 2), "i8")]
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                raw = text.encode()
                view, rows = memoryview(raw), spans(raw, run)
                ids += [doc] * len(rows)
                digests += [hashlib.md5(raw).digest()] * len(rows)
                found += [hashed(view[a:b]) for a, b in rows.tolist()]
                places.append(rows)
            place = np.concatenate(places)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(found, pa.binary()),
                    pa.array(place[:, 0]), pa.array(place[:, 1] - place[:, 0]),
                ],
                names=["doc_id", "digest", "window", "start", "size"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, WINDOWS)


def union(rows: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted ranges (start, end), put together where they touch."""
    out: list[list[int]] = []
    for a, b in rows:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def minus(some: list[list[int]], others: list[list[int]]) -> list[list[int]]:
    """What of the ranges ``some`` no range of ``others`` covers; both sorted and apart."""
    out, k = [], 0
    for a, b in some:
        while k < len(others) and others[k][1] <= a:
            k += 1
        i = k
        while i < len(others) and others[i][0] < b:
            if others[i][0] > a:
                out.append([a, others[i][0]])
            a = max(a, others[i][1])
            i += 1
        if a < b:
            out.append([a, b])
    return out


def dedup(docs: DataFrame, run: int = RUN, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_repeated, n_removed, n_spans, kept_sha256, repeated, removed`` and, if asked for, ``kept``.

    ``repeated`` has the ranges that other places hold as well, ``removed`` those that are not first.
    """
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    with passing() as keep:
        cut = windows(named, run)
        again = settle(cut.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window"))
        held = settle(cut.join(again, "window"))
        place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "digest", "start")
        # Written before it is joined, so that a window of many places can be split.
        firsts = settle(held.groupBy("window").agg(F.min(place).alias("least")))
        part = F.struct("start", "size", (place == F.col("least")).alias("first"))
        parts = held.join(firsts, "window").groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(part)).alias("parts"))
        parts = keep(parts.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "parts"))

    def apply(batches):
        for batch in batches:
            rows = []
            for doc, text, found in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "parts")), strict=True):
                raw = text.encode()
                ranges = [(p["start"], p["start"] + p["size"], p["first"]) for p in found or []]
                runs = union([r[:2] for r in ranges])
                out = minus(union([r[:2] for r in ranges if not r[2]]), union([r[:2] for r in ranges if r[2]]))
                kept, at = [], 0
                for a, b in out:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                rows.append((
                    doc, len(raw), sum(r[1] - r[0] for r in runs), len(raw) - len(left), len(out),
                    hashlib.sha256(left).hexdigest(), runs, out, left,
                ))
            names = ["doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans", "kept_sha256", "repeated", "removed", "kept"]
            spans = pa.list_(pa.list_(pa.int64()))
            kinds = [*[pa.int64()] * 5, pa.string(), spans, spans, pa.binary()]
            count = len(names) - (not keep_text)
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:count], kinds[:count], strict=True)], names=names[:count])

    keyed = named.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    joined = keyed.join(parts, keyed["doc_id"].eqNullSafe(F.col("_doc")) & (keyed["digest"] == F.col("_digest")), "left")
    schema = (
        "doc_id long, n_bytes long, n_repeated long, n_removed long, n_spans long, kept_sha256 string, "
        "repeated array<array<long>>, removed array<array<long>>"
    )
    return joined.select("doc_id", "text", "parts").mapInArrow(apply, schema + (", kept binary" if keep_text else ""))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans", "kept_sha256")
