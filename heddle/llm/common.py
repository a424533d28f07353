"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"

#: Bytes of keys that are sent to every executor at most; more are joined by shuffling.
BROADCAST_BYTES = 16 << 20

#: Removes a query's shuffle files when it has ended, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of an Arrow batch of whole texts, where two tasks of an executor hold one each in the JVM and in Python.
TEXTS_AT_ONCE = 1000

_ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Tells how much a step remembers in this Python worker, and forgets it.
_remembered: list[Callable] = []

_open: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("open", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary folder stands in for it
    if driver and executors are one process; anywhere else a local folder would lose rows, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="heddle-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a read of the table, not a second run
    of what made it. The table goes at the end of the ``passing`` block that it is settled in, or else
    when the driver's Python ends.
    """
    return _settle(df, _open.get())


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables settled within this block go at its end, so what the block returns must not read them.

    The block gets ``keep``, which settles a table that belongs to the block around (or to the session).
    """
    around, own = _open.get(), []
    mark = _open.set(own)
    try:
        yield lambda df: _settle(df, around)
    finally:
        _open.reset(mark)
        for spark, path in own:
            _remove(spark, path)


def _settle(df: DataFrame, owner: list[tuple[SparkSession, str]] | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/heddle-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
        if owner is None:
            atexit.register(_remove, spark, path)
        else:
            owner.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may have ended before
        pass


def drop(df: DataFrame) -> None:
    """Remove a settled table before the end of its block, when nothing reads it any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("heddle-"):
            _remove(df.sparkSession, folder)


def few(keys: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``keys`` (a settled table of narrow rows), marked for broadcasting if its values, written out, have ``most`` bytes or fewer."""
    size = F.octet_length(F.to_json(F.struct(*keys.columns))) + 32
    held = keys.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(keys) if held <= most else keys


@contextmanager
def texts_at_once(spark: SparkSession, rows: int = TEXTS_AT_ONCE) -> Iterator[None]:
    """What is written within this block sends ``rows`` rows at most to Python at once, or fewer if the session says so."""
    before = spark.conf.get(_ROWS_AT_ONCE, None)
    if before is None or not 0 < int(before) <= rows:  # below one: no limit
        spark.conf.set(_ROWS_AT_ONCE, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ROWS_AT_ONCE)
        else:
            spark.conf.set(_ROWS_AT_ONCE, before)


def remembers(cached: Callable) -> Callable:
    """Marks a function with an ``lru_cache`` of much memory, which ``forget`` empties."""
    _remembered.append(cached)
    return cached


def forget() -> None:
    """Give back what other steps remember in this Python worker. Spark uses workers again for as long as they are not idle for a minute."""
    held = [cached for cached in _remembered if cached.cache_info().currsize]
    for cached in held:
        cached.cache_clear()
    if held:
        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim is not None:
            trim(0)


def forgetting(run: Callable) -> Callable:
    """``run``, a function for ``mapInArrow``, in a worker that has forgotten what other steps remember."""

    def alone(batches):
        forget()
        yield from run(batches)

    return alone


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of anything but SPACES, as an array."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
