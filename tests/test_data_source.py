"""The data source with its filters, growing recordings, headers as relations, and the interval join."""

from __future__ import annotations

import io
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from myospark.operators import tracks
from myospark.operators.tracks import interval_join
from myospark.sources import encode, files, headers, otb, otb4, source
from myospark.sources.archives import Archive
from myospark.sources.files import read_recordings
from tests.test_sources import LONG, long_otb, otb_bytes, track


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHUNK", 10_000)
    source.register(spark)
    (tmp_path / "a.otb+").write_bytes(long_otb("tar"))
    (tmp_path / "b.otb4").write_bytes(encode.encode_otb4([track(NumberOfChannels=3)], {"a.sig": encode.interleaved(LONG, "<i2")}, "zip"))
    (tmp_path / "notes.txt").write_text("no recording")
    return tmp_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_source_gives_what_the_reader_gives(spark, folder):
    columns = ["file_id", "file_size", "channel_idx", "description", "chunk_idx", "start_sample", "samples"]
    want = read_recordings(spark, [str(folder / "a.otb+"), str(folder / "b.otb4")]).select(columns).orderBy("file_id", "channel_idx", "chunk_idx").collect()
    got = spark.read.format("recording").load(str(folder)).select(columns).orderBy("file_id", "channel_idx", "chunk_idx").collect()
    assert got == want and len(got) == 2 * 3 * 20
    heads = spark.read.format("recording").option("header_only", "true").load(str(folder / "*.otb4"))
    assert heads.count() == 3 and "samples" not in heads.columns


@pytest.mark.parametrize("where", ["channel_idx = 1", "channel_idx in (0, 2) and chunk_idx >= 18", "start_sample > 10000 and start_sample <= 30000", "file_name = 'a.otb+' and chunk_idx = 3", "start_sample = 40001", "chunk_idx < 2 and file_type = 'otb4' and channel_idx = 0", "channel_idx = 1 and sampling_frequency > 2010", "channel_idx = 1 or chunk_idx = 0", "channel_idx = 1 and channel_idx = 2"])
def test_filters_are_pushed_and_right(spark, folder, where):
    whole = spark.read.format("recording").load(str(folder)).select("file_name", "channel_idx", "chunk_idx", "start_sample", "sampling_frequency", "file_type").collect()
    plain = spark.createDataFrame(whole).where(where)
    df = spark.read.format("recording").load(str(folder)).where(where)
    key = ["file_name", "channel_idx", "chunk_idx"]
    assert sorted(map(tuple, df.select(key).collect())) == sorted(map(tuple, plain.select(key).collect()))
    if " or " not in where and "sampling" not in where:
        assert "Filter (" not in plan(df)


def test_pushed_filters_skip_files_parts_and_chunks(folder, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringContains

    reader = source.RecordingReader(str(folder), False, False)
    rest = [StringContains(("description",), "x"), EqualTo(("sampling_frequency",), 2048.0)]
    assert list(reader.pushFilters([EqualTo(("file_name",), "a.otb+"), *rest, GreaterThanOrEqual(("start_sample",), 150_001), LessThan(("chunk_idx",), 17), EqualTo(("channel_idx",), 2)])) == rest
    (part,) = reader.partitions()
    assert part.path.endswith("a.otb+") and reader.bounds == (16, 17)
    taken, opened = [0], source.open_file

    class Spy(io.BytesIO):
        def read(self, *size):
            out = super().read(*size)
            taken[0] += len(out)
            return out

    monkeypatch.setattr(source, "open_file", lambda path: Spy(opened(path).read()))
    (batch,) = list(reader.read(part))
    assert batch.num_rows == 1 and batch.column("chunk_idx").to_pylist() == [16]
    assert taken[0] < 10_000 * 3 * 2 + 30_000 < part.size / 10


def test_growing_recordings_give_each_chunk_once(spark, tmp_path):
    """Restarts from the checkpoint, between appends of any size; the rest comes when the recording is done."""
    source.register(spark)
    (tmp_path / "in").mkdir()
    sig, xml = tmp_path / "in" / "r.sig", Archive(io.BytesIO(long_otb("tar"))).read("rec.xml")
    raw = encode.interleaved(LONG[:, :3050], "<i2")
    (tmp_path / "in" / "r.xml").write_bytes(xml)

    def once():
        q = spark.readStream.format("recording").option("growing", "true").option("chunk", "500").load(str(tmp_path / "in"))
        done = q.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        assert done.awaitTermination(120) and done.exception() is None
        return spark.read.parquet(str(tmp_path / "out")).orderBy("channel_idx", "start_sample").collect()

    sizes = [6 * 700 + 1, 6 * 700 + 3, 6 * 2100, len(raw)]
    for size, chunks in zip(sizes, (1, 1, 4, 6), strict=True):
        sig.write_bytes(raw[:size])
        got = once()
        assert [(r["channel_idx"], r["start_sample"]) for r in got] == [(c, 500 * k) for c in range(3) for k in range(chunks)]
    (tmp_path / "in" / "r.done").write_text("")
    got = once()
    assert len(got) == 3 * 7 and got == once()
    for c in range(3):
        own = [r for r in got if r["channel_idx"] == c]
        assert [x for r in own for x in r["samples"]] == (LONG[c, :3050] * 4.8 / 2.0**16 * 1000).tolist() and [r["chunk_idx"] for r in own] == list(range(7))


def test_headers_as_relations(spark):
    """The same as the readers' parsers say, also for defaults, blanks, padded placeholders and repeated entries."""
    texts = {
        "plain": Archive(io.BytesIO(otb_bytes())).read("rec.xml").decode(),
        "odd": """<?xml version="1.0"?><D SampleFrequency=" 512 " DeviceTotalChannels="3"><Channels><Adapter ID=" A " Description="not defined" Gain="2"><Channel ID="Not Defined " Prefix=" p"/><Channel Index="1" Gain="7" Muscle="m &amp; n"/></Adapter></Channels>
            <Channels><Adapter ChannelStartIndex="1" Type="t"><Channel Index="0" Description=""/><Channel Index="1" Side="é"/></Adapter></Channels></D>""",
        "bare": """<D DeviceTotalChannels="-1"><Channels/></D>""",
    }
    table = spark.createDataFrame(list(texts.items()), "file string, xml string")
    found = {}
    for r in headers.otb_channels(table, "file").collect():
        found.setdefault(r["file"], {})[r["channel_idx"]] = tuple(r)[2:]
    for name, text in texts.items():
        h = otb.parse_header(text.encode())
        assert found.get(name, {}) == {c: (h.adapter_ids[c], h.adapter_types[c], h.gains[c], h.descriptions[c]) for c in range(h.channels) if h.descriptions[c] is not None}
        d = headers.otb_devices(table, "file").where(F.col("file") == name).first()
        assert (d["device"], d["sampling_frequency"], d["bits"], d["channels"]) == (h.device, h.rate, h.bits, h.channels)


def test_lists_of_tracks_as_relations(spark):
    tracks = [track(NumberOfChannels=2, ADC_Nbits=24, SubTitle=" a\tb "), track(Gain="0.5", NumberOfChannels=0), {"Device": "", "NumberOfChannels": 3}, {"SamplingFrequency": " 100 ", "AcquisitionChannel": 7, "SubTitle": "x"}]
    xml = Archive(io.BytesIO(encode.encode_otb4(tracks, {}))).read("Tracks_000.xml")
    table = spark.createDataFrame([("f", xml.decode()), ("g", "<ArrayOfTrackInfo/>")], "file string, xml string")
    got = headers.otb4_tracks(table, "file").orderBy("track_idx").collect()
    want = otb4.parse_tracks(xml)
    assert [tuple(r)[2:] for r in got] == [(t.device, t.gain, t.bits, t.volts, t.rate, t.path, t.channels, t.acquisition_channel, t.subtitle) for t in want]
    channels = headers.otb4_channels(table, "file").orderBy("channel_idx").collect()
    assert [r["description"] for r in channels] == [d for t in want for d in t.describe()]
    assert [r["factor"] for r in channels] == [t.factor for t in want for _ in range(t.channels)]


def test_interval_join(spark):
    """Overlaps, gaps, long and short ranges, empty ones, nulls and one hot key, against all pairs; without a nested loop."""
    rng = random.Random(4)
    points = [(rng.choice(["a", "b", "hot", "hot", None]), rng.randint(-50, 3000), i) for i in range(600)] + [("a", None, -1)]
    ranges = [(rng.choice(["a", "hot", None]), s := rng.randint(-60, 2500), s + rng.choice([0, 1, 2, 3, 7, 8, 9, 100, 1500, -4]), j) for j in range(150)] + [("a", 5, None, 900), ("a", None, 7, 901)]
    left, right = spark.createDataFrame(points, "k string, at long, i int"), spark.createDataFrame(ranges, "k string, low long, high long, j int")
    out = interval_join(left, right, ["k"], "at")
    want = sorted((i, j) for k, at, i in points for q, low, high, j in ranges if k is not None and k == q and None not in (at, low, high) and low <= at < high)
    assert sorted((r["i"], r["j"]) for r in out.collect()) == want and len(want) > 500
    assert set(out.columns) == {"k", "at", "i", "low", "high", "j"}
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert interval_join(left, right.limit(0), ["k"], "at").count() == 0 and interval_join(left.limit(0), right, ["k"], "at").count() == 0


def test_small_files_share_tasks(spark, tmp_path):
    """Tasks grow with bytes, and for small files far slower than their number; all files are read once."""
    content = encode.encode_otb4([track()], {"a.sig": encode.interleaved(np.arange(4)[None, :], "<i2")})
    for i in range(700):
        (tmp_path / f"{i}.otb4").write_bytes(content)
    for header_only in (False, True):
        found = spark.read.format("recording").option("header_only", header_only).load(str(tmp_path))
        assert found.rdd.getNumPartitions() < 100
        assert sorted(r["file_name"] for r in found.select("file_name").collect()) == sorted(f"{i}.otb4" for i in range(700))


def test_tasks_by_bytes_and_files():
    small, large = [(f"s{i}", 100, 0, 1) for i in range(20_000)], [("l", 8 * files.SPLIT_BYTES, k, 8) for k in range(8)]
    out = source.shared_out(large + small, False)
    assert [p for task in out for p in task.parts] == large + small and all(len(task.parts) == 1 for task in out[:8])
    assert 100 < len(out) < 200
    assert len(source.shared_out(small[:10], False)) == 10 and source.shared_out([], True) == []


def test_pairs_of_one_key_are_dealt_over_tasks(spark, monkeypatch):
    """Few keys, many pairs: all of them, and none in tasks far beyond their share."""
    monkeypatch.setattr(tracks, "SIDE", 16, raising=False)
    monkeypatch.setattr(tracks, "TASK_PAIRS", 1000, raising=False)
    points, ranges = [("hot" if i % 50 else "b", i % 90, i) for i in range(1500)], [("hot" if j % 20 else "b", j % 30, j % 30 + 50 + j % 13, j) for j in range(240)]
    left = spark.createDataFrame(points, "k string, at long, i int").withColumn("m", F.create_map(F.lit("x"), "i"))
    out = interval_join(left, spark.createDataFrame(ranges, "k string, low long, high long, j int"), ["k"], "at")
    want = sorted((i, j) for k, at, i in points for q, low, high, j in ranges if k == q and low <= at < high)
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["i"], r["j"]) for r in got) == want and len(want) > 100_000
    assert all(r["m"] == {"x": r["i"]} for r in got) and set(out.columns) == {"k", "at", "i", "m", "low", "high", "j"}
    assert max(Counter(r["task"] for r in got).values()) < 5_000


def test_a_long_range_is_not_copied_into_many_bins(spark):
    right = spark.createDataFrame([(0, 0, 10**9, 1), (0, 5, 6, 2)], "k int, low long, high long, j int")
    left = spark.createDataFrame([(0, x) for x in (0, 5, 10**9 - 1, 10**9)], "k int, at long")
    assert sorted((r["at"], r["j"]) for r in interval_join(left, right, ["k"], "at").collect()) == [(0, 1), (5, 1), (5, 2), (10**9 - 1, 1)]
