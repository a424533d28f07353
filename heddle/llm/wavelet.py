"""Token files as wavelet matrices: one compressed file image per shard.

A shard holds the ids of consecutive documents. Its matrix has one bit-plane per binary
digit, the highest first; below each plane the ids are stably parted, zeros before ones. With
counts of ones at block edges (rank) and their inverse (select) a reader finds the id at a place, counts
an id in a range and finds its k-th occurrence, without the ids themselves.

File image: magic ``HWM2``, then as little-endian u32 the number of documents, ids and planes, then
the document ids (i64), a byte per document that says whether its id is null, the ids per document
(u32), and a directory: for each plane and block of ``BLOCK`` bits the length of its Zstandard frame and its ones (u32 each);
then the frames. An access, a count or a search unpacks one block of each plane (a range two), never whole planes.

``save_shards`` keeps shards at a path, by the place of their first id, and ``load_shards`` and ``find_id`` read them from there in any session.

The corpus is range-partitioned by document id and every partition writes its shards through Spark, one
row per image, so a lost executor costs its own shards. Shards of one partition follow in ``seq``.

Defined results: null texts are empty; an empty text is the end id alone; documents with null ids come
first; repeated ids stay, ordered by the texts' digests; a long text makes a long shard of its own; other columns, whatever their
names, are not written; an empty table has no shards.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.common import settle, table, text_of
from heddle.llm.tokens import encoder
from heddle.sources import frames

VOCABULARY = "word_bpe_49k.json"
END = 2
SHARD_IDS = 1 << 20
#: Bits that are compressed together; whole bytes.
BLOCK = 1 << 16

MAGIC = b"HWM2"
SHARDS = "part int, seq int, n_docs long, n_ids long, image binary"


def build(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The file image of one shard."""
    import zstandard

    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    x = ids.astype("u2") if planes <= 16 else ids.astype("u4")
    below = np.empty_like(x)
    pack = zstandard.ZstdCompressor(level=1)
    framed, directory = [], []
    for p in range(planes - 1, -1, -1):
        ones = (x & x.dtype.type(1 << p)).astype(bool)
        bits = np.packbits(ones).tobytes()
        for at in range(0, len(bits), BLOCK // 8):
            part = bits[at : at + BLOCK // 8]
            framed.append(pack.compress(part))
            directory += [len(framed[-1]), int(np.bitwise_count(np.frombuffer(part, "u1")).sum(dtype="i8"))]
        if p:
            # Block by block, so that what is parted stays in the processor's cache.
            zero, one = 0, len(x) - int(np.count_nonzero(ones))
            for at in range(0, len(x), BLOCK):
                part, high = x[at : at + BLOCK], ones[at : at + BLOCK]
                places = np.flatnonzero(~high)
                below[zero : zero + len(places)] = part[places]
                zero += len(places)
                places = np.flatnonzero(high)
                below[one : one + len(places)] = part[places]
                one += len(places)
            x, below = below, x
    return b"".join([
        MAGIC, struct.pack("<3I", len(doc_ids), len(ids), planes),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids),
        np.array(lengths, "<u4").tobytes(), np.array(directory, "<u4").tobytes(), *framed,
    ])


class Shard:
    """Reads a file image, block by block as they are needed."""

    def __init__(self, image: bytes):
        import zstandard

        if image[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        docs, self.n, self.planes = struct.unpack_from("<3I", image, 4)
        at = 16

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(image, kind, count, at)
            at += found.nbytes
            return found

        values, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(v) for v, z in zip(values, nulls, strict=True)]
        self.lengths = take("<u4", docs)
        self.blocks = -(-self.n // BLOCK)
        directory = take("<u4", 2 * self.planes * self.blocks).reshape(self.planes, self.blocks, 2).astype("i8")
        self.image, self.unpack = image, zstandard.ZstdDecompressor().decompress
        ends = at + np.cumsum(directory[:, :, 0].ravel())
        self.edges = np.concatenate([[at], ends])
        #: For each plane, the ones before each block and in all.
        self.ranks = np.concatenate([np.zeros((self.planes, 1), "i8"), np.cumsum(directory[:, :, 1], axis=1)], axis=1)
        self.open: dict[int, np.ndarray] = {}

    def block(self, plane: int, number: int) -> np.ndarray:
        """The bytes of a block; the last few dozen blocks are kept."""
        key = plane * self.blocks + number
        if (found := self.open.get(key)) is None:
            if len(self.open) >= 4 * self.planes:
                self.open.clear()
            found = self.open[key] = np.frombuffer(self.unpack(self.image[self.edges[key] : self.edges[key + 1]]), "u1")
        return found

    def _bit(self, plane: int, at: int) -> int:
        return int(self.block(plane, at // BLOCK)[at % BLOCK >> 3]) >> (7 - (at & 7)) & 1

    def rank(self, plane: int, bit: int, at: int) -> int:
        """How many of the plane's first ``at`` bits equal ``bit``."""
        number, inside = divmod(at, BLOCK)
        ones = int(self.ranks[plane][number])
        if inside:
            bits = self.block(plane, number)
            ones += int(np.bitwise_count(bits[: inside >> 3]).sum(dtype="i8"))
            if inside & 7:
                ones += (int(bits[inside >> 3]) >> (8 - (inside & 7))).bit_count()
        return ones if bit else at - ones

    def select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit of the plane."""
        ones = self.ranks[plane]
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        low = int(np.searchsorted(before, k, "right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.block(plane, low))[: self.n - low * BLOCK] == bit)
        return low * BLOCK + int(inside[k - int(before[low])])

    def _zeros(self, plane: int) -> int:
        return self.n - int(self.ranks[plane][-1])

    def access(self, at: int) -> int:
        """The id at a place."""
        value = 0
        for plane in range(self.planes):
            bit = self._bit(plane, at)
            value = value << 1 | bit
            at = self.rank(plane, bit, at) + (self._zeros(plane) if bit else 0)
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for plane in range(self.planes):
            bit = value >> (self.planes - 1 - plane) & 1
            base = self._zeros(plane) if bit else 0
            start, end = base + self.rank(plane, bit, start), base + self.rank(plane, bit, end)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs from ``start`` up to ``end``."""
        if value >> self.planes:
            return 0
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def find(self, value: int, k: int) -> int | None:
        """The place of the k-th (from 0) occurrence of an id."""
        if value >> self.planes:
            return None
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            return None
        at = a + k
        for plane in range(self.planes - 1, -1, -1):
            bit = value >> (self.planes - 1 - plane) & 1
            at = self.select(plane, bit, at - (self._zeros(plane) if bit else 0))
        return at

    def ids(self) -> np.ndarray:
        """All ids in order, as u32: the partings undone from the lowest plane up."""
        x = np.zeros(self.n, "u2" if self.planes <= 16 else "u4")
        for p in range(self.planes):
            plane = self.planes - 1 - p
            keys = range(plane * self.blocks, (plane + 1) * self.blocks)
            bits = b"".join(self.unpack(self.image[self.edges[k] : self.edges[k + 1]]) for k in keys)
            ones = np.unpackbits(np.frombuffer(bits, "u1"), count=self.n).view(bool)
            low, high = np.flatnonzero(~ones), np.flatnonzero(ones)
            above = np.empty_like(x)
            above[low] = x[: len(low)]
            above[high] = x[len(low) :] | x.dtype.type(1 << p)
            x = above
        return x.astype("<u4")


def write_shards(
    docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, shard_ids: int = SHARD_IDS, text_col: str = "text"
) -> DataFrame:
    """The shards of ``docs`` in ascending document id order, written to the shared folder."""

    def shards(batches):
        from pyspark import TaskContext

        part, tokens = TaskContext.get().partitionId(), encoder(vocabulary)
        ids, docs_, lengths, held, seq = [], [], [], 0, 0

        def image():
            whole = build(docs_, lengths, np.concatenate(ids))
            row = [[part], [seq], [len(docs_)], [held], [whole]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "seq", "n_docs", "n_ids", "image"]
            )

        for batch in batches:
            for at in range(0, len(batch), 1000):
                piece = batch.slice(at, 1000)
                found, sizes = tokens.encode_all(piece["text"])
                found, start = np.insert(found, np.cumsum(sizes), end), 0  # an end id after each text
                for doc, size in zip(piece["doc_id"].to_pylist(), (sizes + 1).tolist(), strict=True):
                    docs_.append(doc)
                    ids.append(found[start : start + size])
                    start += size
                    lengths.append(size)
                    held += size
                    if held >= shard_ids:
                        yield image()
                        ids, docs_, lengths, held, seq = [], [], [], 0, seq + 1
        if docs_:
            yield image()

    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    # Equal ids are parted by their texts' digests, in which order they stay.
    ranged = named.withColumn("digest", F.md5(F.col("text").cast("binary"))).repartitionByRange(F.col("doc_id").asc_nulls_first(), "digest")
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "digest").drop("digest")
    return settle(ordered.mapInArrow(shards, SHARDS))


def placed(shards: DataFrame) -> DataFrame:
    """``shards`` with ``start``, the ids in all shards before."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    # One row per partition of the writer: a few thousand at most.
    firsts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_first"))
    inside = Window.partitionBy("part").orderBy("seq")
    sized = shards.select("part", "seq", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("_inside"))
    starts = sized.join(firsts, "part").select("part", "seq", (F.col("_first") + F.col("_inside")).alias("start"))
    # One row for each shard of a million ids goes to the images, which stay where they are.
    return shards.join(F.broadcast(starts), ["part", "seq"])


def save_shards(shards: DataFrame, uri: str) -> None:
    """Keep ``shards`` at ``uri`` (see ``heddle.sources.frames``) until they are deleted, in place of what is there."""
    kept = placed(shards).select("start", "n_docs", "n_ids", "image")
    frames.write_frames(kept, uri, "start", mode="overwrite")


def load_shards(spark: SparkSession, uri: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """``start, n_docs, n_ids, image`` of the shards at ``uri`` whose first id is at a place from ``least`` to ``most``; others are not read."""
    return frames.read_frames(spark, uri, least, most)


def occurrences(shards: DataFrame, value: int) -> DataFrame:
    """``start, n``: how often an id occurs in each shard, from one or two blocks of each plane."""

    def count(batches):
        for batch in batches:
            n = [Shard(image.as_py()).count(value) for image in batch["image"]]
            yield pa.RecordBatch.from_arrays([batch["start"], pa.array(n, pa.int64())], names=["start", "n"])

    return shards.select("start", "image").mapInArrow(count, "start long, n long")


def find_id(spark: SparkSession, uri: str, value: int, k: int) -> int | None:
    """The place, among all ids at ``uri``, of the k-th (from 0) occurrence of an id. The shard that has it is read alone."""
    counts = settle(occurrences(load_shards(spark, uri), value))
    # One row for each shard of a million ids.
    before = (F.sum("n").over(Window.orderBy("start")) - F.col("n")).alias("before")
    held = counts.select("start", "n", before).filter((F.col("before") <= k) & (F.col("before") + F.col("n") > k)).first()
    if held is None:
        return None
    shard = load_shards(spark, uri, held["start"], held["start"]).select("image").first()
    return held["start"] + Shard(bytes(shard["image"])).find(value, k - held["before"])


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files (``placed`` or not): ``doc_id start n_tokens ids_crc32``."""

    def read(batches):
        for batch in batches:
            for start, image in zip(batch["start"].to_pylist(), batch["image"], strict=True):
                shard = Shard(image.as_py())
                whole, edges = shard.ids().tobytes(), np.concatenate([[0], np.cumsum(shard.lengths, dtype="i8")])
                view = memoryview(whole)
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(start + edges[:-1]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    whole = shards if "start" in shards.columns else placed(shards)
    return whole.select("start", "image").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_binary(spark, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents")))
