import json
import os
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.sources import frames

SF = "/root/testdata/sf0.001"


def _files(place) -> list[str]:
    return sorted(f for _, _, names in os.walk(place) for f in names)


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_round_trip_of_whole_tables(spark, tmp_path):
    for name, key in (("documents", "doc_id"), ("events", "event_id"), ("embeddings", "vec_id"), ("orders", "o_orderkey")):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        place = str(tmp_path / name)
        frames.write_frames(df, place, key, files=5)
        back = frames.read_frames(spark, place)
        assert back.schema.simpleString() == df.schema.simpleString()
        assert _rows(back) == _rows(df)


def test_ranges_open_few_files(spark, tmp_path):
    place = str(tmp_path / "t")
    df = spark.range(10_000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 50).alias("x"), (F.col("id") % 7).alias("y"))
    frames.write_frames(df, place, "k", files=10)
    reader = frames.FrameReader(place, 5_100, 5_199, ["k"])
    assert len(reader.partitions()) <= 2 < len(frames.FrameReader(place, None, None, ["k"]).partitions())
    assert frames.read_frames(spark, place, 5_100, 5_199, ["y", "k"]).agg(F.count("*"), F.min("k"), F.max("k"), F.sum("y")).first() == (
        100, 5_100, 5_199, sum(i % 7 for i in range(5_100, 5_200)),
    )
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = spark.read.format(frames.NAME).option("pushdown", "true").load(place)
        assert read.filter("k >= 9_000 AND k < 9_010 AND y = 5".replace("_", "")).count() == sum(i % 7 == 5 for i in range(9_000, 9_010))
        assert read.filter("k = 77").count() == 1 and read.filter("k IN (3, 5, 99999)").count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    pushing = frames.PushingReader(place, None, None, ["k"])
    assert len(list(pushing.pushFilters([frames.GreaterThanOrEqual(("k",), 9_000), frames.LessThan(("y",), 3)]))) == 2
    assert (pushing.least, pushing.most) == (9_000, None) and len(pushing.partitions()) < 4


def test_batches_outside_a_range_are_not_read(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "t")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        frames.write_frames(spark.range(1_000).withColumnRenamed("id", "k"), place, "k", files=1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    reader = frames.FrameReader(place, 250, 349, ["k"])
    (part,) = reader.partitions()
    read = []
    monkeypatch.setattr(reader, "_cut", lambda b: read.append(b.num_rows) or frames.FrameReader._cut(reader, b))
    assert sum(b.num_rows for b in reader.read(part)) == 100 and read == [100, 100]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    place = str(tmp_path / "t")
    frames.write_frames(spark.range(10).withColumnRenamed("id", "k"), place, "k", files=2)
    before = _files(place)
    bad = spark.range(0, 4_000, 1, 4).select(F.when(F.col("id") < 3_999, F.col("id")).otherwise(F.raise_error("no")).cast("long").alias("k"))
    with pytest.raises(Exception, match="no"):
        bad.write.format(frames.NAME).option("key", "k").mode("append").save(place)
    assert _files(place) == before and frames.read_frames(spark, place).count() == 10


def test_files_of_lost_attempts_go(spark, tmp_path):
    df = spark.createDataFrame([], "k long")
    writer = frames.FrameWriter(str(tmp_path), "k", df.schema, False, 1)
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, None]})
    lost, won = writer.write(iter([batch])), writer.write(iter([batch, batch]))
    assert lost.files != won.files and len(won.files) == 2  # a file is closed at its size
    writer.commit([won, None])
    assert len(_files(tmp_path)) == 5 and frames.read_frames(spark, str(tmp_path)).count() == 6
    assert frames.read_frames(spark, str(tmp_path), least=0).count() == 4  # a range leaves null keys out


def test_appending_overwriting_and_vacuum(spark, tmp_path):
    place = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "k long, v string")
    with pytest.raises(Exception, match="no version"):
        frames.read_frames(spark, place)
    frames.write_frames(df.limit(0), place, "k")
    assert frames.read_frames(spark, place).count() == 0
    frames.write_frames(df, place, "k")
    frames.write_frames(df, place, "k")
    assert _rows(frames.read_frames(spark, place)) == sorted(_rows(df) * 2)
    with pytest.raises(Exception, match="another schema"):
        frames.write_frames(df.withColumn("w", F.lit(1)), place, "k")
    frames.write_frames(df.withColumn("w", F.lit(1)), place, "k", mode="overwrite")
    assert frames.read_frames(spark, place).columns == ["k", "v", "w"] and frames.read_frames(spark, place).count() == 3
    assert frames.vacuum(place) >= 2 and frames.read_frames(spark, place).count() == 3
    assert [json.loads(p.read_text())["replaces"] for p in (Path(place) / "versions").iterdir()] == [True]
    with pytest.raises(Exception, match="whole numbers"):
        frames.write_frames(df, str(tmp_path / "u"), "v")


def test_stream_writes_each_batch_once(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "value")
    table.repartition(4).write.parquet(str(tmp_path / "in"))
    frames.register(spark)

    def run():
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        out = stream.writeStream.format(frames.NAME).option("key", "event_id").option("checkpointLocation", str(tmp_path / "cp"))
        out.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)

    run()
    assert _rows(frames.read_frames(spark, str(tmp_path / "out"))) == _rows(table)
    # The last batch's commit is lost, so it is run again after the restart.
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in (tmp_path / "cp" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    files = _files(tmp_path / "out")
    run()
    assert _rows(frames.read_frames(spark, str(tmp_path / "out"))) == _rows(table) and _files(tmp_path / "out") == files
