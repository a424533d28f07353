"""Token files that stay: read back in another session, searched block by block."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from heddle.llm import tokens, wavelet

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, wavelet.BLOCK - 1, wavelet.BLOCK, 3 * wavelet.BLOCK + 5])
def test_shards_of_any_length(n):
    x = np.random.default_rng(n).integers(0, 70_000, n)
    x[::11] = 5
    shard = wavelet.Shard(wavelet.build([7], [n], x))
    assert (shard.ids() == x).all() and shard.n == n
    for at in range(0, n, max(1, n // 40)):
        assert shard.access(at) == x[at]
    places = np.flatnonzero(x == 5)
    assert shard.count(5) == len(places) and shard.find(5, len(places)) is None and shard.count(1 << 20) == 0
    for k in range(0, len(places), max(1, len(places) // 20)):
        assert shard.find(5, k) == places[k]
    assert shard.count(5, n // 3, n - n // 5) == (x[n // 3 : n - n // 5] == 5).sum()


def test_an_access_unpacks_one_block_of_each_plane():
    x = np.random.default_rng(1).integers(0, 1 << 12, 10 * wavelet.BLOCK)
    shard = wavelet.Shard(wavelet.build([1], [len(x)], x))
    unpacked = []
    unpack = shard.unpack
    shard.unpack = lambda raw: unpacked.append(1) or unpack(raw)
    assert shard.access(5 * wavelet.BLOCK + 77) == x[5 * wavelet.BLOCK + 77]
    assert len(unpacked) == shard.planes == 12
    place = shard.find(int(x[3]), 2)
    assert place == np.flatnonzero(x == x[3])[2]
    assert len(unpacked) <= 4 * shard.planes  # two ends of a range on the way down, one block on the way up; of 120 in all


def test_files_stay_and_are_found_again(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    place = str(tmp_path / "tokens")
    wavelet.save_shards(wavelet.write_shards(docs, shard_ids=4_000), place)
    shards = wavelet.load_shards(spark, place)
    assert shards.count() > 10
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert rows(wavelet.read_shards(shards)) == rows(wavelet.read_shards(wavelet.write_shards(docs)))
    whole = tokens.encoder(wavelet.VOCABULARY)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    ids = np.concatenate([np.append(np.frombuffer(x, "<u4"), wavelet.END) for x in whole.encode(texts)])
    value = int(ids[1_000])
    found = np.flatnonzero(ids == value)
    for k in (0, len(found) // 2, len(found) - 1):
        assert wavelet.find_id(spark, place, value, k) == found[k]
    assert wavelet.find_id(spark, place, value, len(found)) is None
    code = (
        "from pyspark.sql import SparkSession; from heddle.llm import wavelet;"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate();"
        f"print('place', wavelet.find_id(s, {place!r}, {value}, 1))"
    )
    root = str(Path(__file__).resolve().parents[2])
    told = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, env=os.environ | {"PYTHONPATH": root}, check=True)
    assert f"place {found[1]}" in told.stdout
    wavelet.save_shards(wavelet.write_shards(docs.limit(0)), place)
    assert wavelet.load_shards(spark, place).count() == 0 and wavelet.find_id(spark, place, value, 0) is None


def test_images_stay_where_they_are_when_they_are_placed(spark):
    rows = [(p, s, 1, 3 + p, b"image") for p in range(3) for s in range(4)]
    shards = spark.createDataFrame(rows, wavelet.SHARDS)
    found = wavelet.placed(shards).orderBy("start")
    assert [(r.part, r.seq) for r in found.collect()] == [(r[0], r[1]) for r in rows]
    plan = wavelet.placed(shards)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan


def test_cuttings_of_many_texts_are_looked_up_once(monkeypatch):
    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

    encoder = tokens.Encoder(wavelet.VOCABULARY)
    monkeypatch.setattr(encoder, "known", Counted())
    monkeypatch.setattr(encoder, "merge", None)  # words go to the library together
    texts = [" ".join(("river", "Über", "don't", "stone,")[(i + k) % 4] for k in range(50)) for i in range(40)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [e.ids for e in encoder.whole.encode_batch(texts, add_special_tokens=False)]
    assert Counted.asked <= 6  # river, Über, don, 't, stone and the comma


@pytest.mark.parametrize("together", [1, 40, 1 << 20])
def test_ids_of_texts_that_are_cut_together(monkeypatch, together):
    monkeypatch.setattr(tokens, "BYTES_TOGETHER", together)
    encoder = tokens.Encoder(wavelet.VOCABULARY, limit=5)
    texts = ["left out", "é", "Ã÷ b×c é÷ ÿ.", "", None, "ΑΣ. Σa, 日本abc, c", "e\u0301, a\u00a0b\u2028c", "a\0b a\0 a", "x\x1cy", "<|endoftext|> a", "\u0301a \u0338= =\u0338",
             "\x85 \x0b\x0c\r\n", "A" * 300 + " b" * 3, "it's 'S 'ſ don't!!'s", "last"]
    column = pa.array(texts).slice(1)
    ids, lengths = encoder.encode_all(column)
    wanted = [e.ids for e in encoder.whole.encode_batch([t or "" for t in texts[1:]], add_special_tokens=False)]
    assert lengths.tolist() == list(map(len, wanted)) and ids.tolist() == sum(wanted, [])
    assert encoder.encode_all(column.slice(0, 0))[1].tolist() == [] and encoder.encode([]) == []
