"""Readers, the MAT codec, recordings, layout, tracks and grids on fixtures made byte by byte."""

from __future__ import annotations

import gzip
import io
import json
import os
import tarfile
import time
import zipfile

import numpy as np
import pytest

from myospark.operators import layout
from myospark.operators.grids import GridCatalog, extract_grids, get_grid
from myospark.operators.tracks import recording_rate, track_ranges
from myospark.recording import Recording
from myospark.sources import encode, files, mat, mat_sink, otb, otb4, stores
from myospark.sources.archives import Archive
from myospark.sources.files import mat_path, read_recordings, type_of
from myospark.sources.mat_sink import write_mat_files
from myospark.streaming.ingest import stream_recordings

X = np.array([[1, 2, 3, 4], [-5, 6, 7, -8], [0, 1, 0, 1]])


def otb_bytes(kind="tar", bits=16, **header):
    adapters = [({"Gain": 5, "ChannelStartIndex": 0, "ID": "A", "Description": "grid"}, [{"Index": 0, "Gain": 2, "Muscle": " bic "}, {"Index": 1, "Side": "not defined"}]), ({"Gain": 0, "ChannelStartIndex": 2, "ID": "B"}, [{"ID": "aux"}])]
    return encode.encode_otb({"Name": "Q", "SampleFrequency": 2048, "ad_bits": bits, "DeviceTotalChannels": 3} | header, adapters, X, kind, b"\1\0")


@pytest.mark.parametrize("kind", ["tar", "zip"])
@pytest.mark.parametrize("bits", [16, 24])
def test_otb(kind, bits):
    d = otb.decode(otb_bytes(kind, bits))
    assert (d.rate, d.n_samples, d.descriptions) == (2048, 4, ["A-grid-bic", "A-grid", "B-aux"])
    head = otb.decode(otb_bytes(kind, bits), header_only=True)
    assert (head.data, head.n_samples, head.n_channels) == (None, 4, 3)
    gains = np.array([[10.0], [25.0], [1.0]])  # of the channel; the adapter's twice; none
    np.testing.assert_array_equal(d.data, X * 4.8 / 2.0**bits * 1000 / gains)


def test_otb_errors():
    with pytest.raises(ValueError, match="channel 3 has no description"):
        otb.decode(otb_bytes(DeviceTotalChannels=4))
    with pytest.raises(ValueError, match="channel 2"):
        otb.decode(otb_bytes(DeviceTotalChannels=2))
    with pytest.raises(FileNotFoundError):
        otb.decode(encode.archive({"a.xml": b"<a/>"}))
    with pytest.raises(FileNotFoundError):
        otb.decode(encode.archive({"a.sig": b""}))
    with pytest.raises(RuntimeError):
        Archive(io.BytesIO(b"plain"))
    assert [otb.channel_total(x) for x in (None, "x", "0", "-1", "7")] == [128, 128, 128, 128, 7]
    assert otb.describe("a", None, "Not defined", " not defined ", " ", "\t b\n") == "a-not defined-b"
    h = otb.parse_header(Archive(io.BytesIO(otb_bytes())).read("rec.xml"))
    assert (h.adapter_ids, h.adapter_types) == (["A", "A", "B"], ["A", "A", "B"])


def test_warnings(caplog):
    otb.decode(otb_bytes())
    streams = {"a.sig": encode.interleaved(X[:1], "<i4"), "b.sig": encode.interleaved(X[:1, :2], "<i4")}
    otb4.decode(encode.encode_otb4([track(Device="Novecento+"), track(SignalStreamPath="b.sig", SamplingFrequency=9)], streams))
    said = " ".join(r.getMessage() for r in caplog.records if r.levelname == "WARNING")
    assert "left over" in said and "cut to 2 samples" in said and "differ in sampling frequency" in said


def track(**more):
    return {"Device": " S ", "Gain": 2, "SignalStreamPath": "a.sig", "NumberOfChannels": 1, "SubTitle": "t"} | more


def test_otb4_one_stream():
    content = encode.encode_otb4([track(NumberOfChannels=2), track(Gain=4)], {"a.sig": encode.interleaved(X, "<i2")}, "zip")
    d = otb4.decode(content)
    assert d.descriptions == ["S-a.sig-t-ch0", "S-a.sig-t-ch1", "S-a.sig-t-ch0"]
    np.testing.assert_array_equal(d.data, X * (5 / 2.0**16 * 1000 / np.array([[2.0], [2.0], [4.0]])))
    empty = otb4.decode(encode.encode_otb4([track()], {}))
    assert (empty.data.shape, empty.descriptions, empty.rate) == ((0, 0), [], 2000)


def test_otb4_stream_for_each_track():
    tracks = [track(Device="Novecento+", SignalStreamPath="a.sig", SamplingFrequency=0), track(Device="x", SignalStreamPath="b.sig", NumberOfChannels=2), track(SignalStreamPath="a.sig", Gain=99)]
    streams = {"a.sig": encode.interleaved(X[:1], "<i4"), "sub/b.sig": encode.interleaved(X[1:, :3], "<i4") + b"\1", "z.sig": b"1234"}
    d = otb4.decode(encode.encode_otb4(tracks, streams))
    np.testing.assert_array_equal(d.data, X[:, :3] * (5 / 2.0**16 * 1000 / 2))
    assert d.rate == 2000 and len(d.descriptions) == 3
    head = otb4.decode(encode.encode_otb4(tracks, streams), header_only=True)
    assert (head.data, head.n_samples, head.n_channels, head.descriptions) == (None, 3, 3, d.descriptions)
    # a track's path is matched as it stands
    assert otb4.decode(encode.encode_otb4([track(Device="Novecento+", SignalStreamPath="sub/b.sig")], streams)).n_channels == 0


def test_otb4_errors():
    for tracks, streams, error in (([track(NumberOfChannels=3)], {"a.sig": b"12" * 4}, ValueError), ([track(NumberOfChannels=0)], {"a.sig": b"12"}, ValueError), ([track(Gain=0)], {"a.sig": b"12"}, ValueError), ([], {}, ValueError)):
        with pytest.raises(error):
            otb4.decode(encode.encode_otb4(tracks, streams))
    with pytest.raises(FileNotFoundError):
        otb4.decode(encode.archive({"sub/Tracks_000.xml": b"<a/>"}))
    with pytest.raises(ValueError):
        otb4.text_of(__import__("xml.etree.ElementTree").etree.ElementTree.fromstring("<a/>"), "b", None, required=True)


def test_mat_codec():
    wide = {"Data": np.arange(12, dtype=np.int16).reshape(2, 6), "Time": np.arange(6.0)[:, None], "Description": ["HD08MM0203", "é", ""], "SamplingFrequency": np.array([[100.0]])}
    back = mat.read_mat(mat.write_mat(wide))
    np.testing.assert_array_equal(back["Data"], wide["Data"])
    assert back["Data"].dtype == np.int16 and back["Description"] == ["HD08MM0203", "é", ""]
    d = mat.decode(mat.write_mat(wide))
    assert (d.n_samples, len(d.data), d.single, d.rate) == (6, 2, True, 100)
    head = mat.decode(mat.write_mat(wide), header_only=True)
    assert (head.n_samples, head.n_channels, head.single, head.data) == (6, 2, True, None)
    assert mat.read_mat(mat.write_mat(wide), "Data")["Data"] == (2, 6)
    plain = mat.decode(mat.write_mat({"Data": np.zeros((4, 2)), "Time": np.zeros(2)}))
    assert (plain.rate, plain.descriptions, plain.time_aligned) == (1.0, None, False)
    with pytest.raises(ValueError):
        mat.decode(mat.write_mat({"Data": np.zeros((4, 2)), "Time": np.zeros(5)}))
    with pytest.raises(KeyError):
        mat.decode(mat.write_mat({"Data": np.zeros((4, 2))}))
    with pytest.raises(ValueError):
        mat.read_mat(b"\x89HDF\r\n\x1a\n" + bytes(200))


def test_recording_round_trip(spark, tmp_path):
    (tmp_path / "a.OTB+").write_bytes(otb_bytes())
    r = Recording.load(spark, str(tmp_path / "a.OTB+"))
    head = r.recordings.first()
    assert (head["file_type"], head["n_samples"], head["channel_count"]) == ("otb", 4, 3)
    (tmp_path / "out").mkdir()
    paths = r.copy().save(str(tmp_path / "out"))
    assert [os.path.basename(p) for p in paths] == ["a.mat"]
    again = read_recordings(spark, paths[0], channels=[1]).collect()
    assert len(again) == 1 and again[0]["description"] == "A-grid"
    np.testing.assert_array_equal(again[0]["samples"], otb.decode(otb_bytes()).data[1])
    assert [c["description"] for c in read_recordings(spark, paths[0], header_only=True).orderBy("channel_idx").collect()] == ["A-grid-bic", "A-grid", "B-aux"]
    assert r.save(str(tmp_path / "named.mat")) == [str(tmp_path / "named.mat")]
    assert write_mat_files(r.signals, target=str(tmp_path / "other.dat")).first()["path"] == str(tmp_path / "other.mat")
    assert not list(tmp_path.glob("**/_temporary*"))
    with pytest.raises(ValueError):
        r.save(str(tmp_path / "named.txt"))
    with pytest.raises(ValueError):
        r.save(str(tmp_path), ".csv")
    with pytest.raises(ValueError):
        Recording.load(spark, "file.unknown")
    assert type_of("x/Y.OTB4") == "otb4" and mat_path("/a/b.otb") == "/a/b.mat"
    assert r.get_grid() is None
    assert [(w["file_id"][-6:], w["warning"]) for w in r.warnings.collect()] == [("a.OTB+", "1 values are left over of 13 for 3 channels")]


class Counting(io.BytesIO):
    """Bytes that count how many of them are read."""

    taken = 0

    def read(self, *size):
        out = super().read(*size)
        self.taken += len(out)
        return out


LONG = np.arange(3 * 200_000).reshape(3, -1) % 3000 - 1500


def long_otb(kind):
    header = {"Name": "Q", "SampleFrequency": 2048, "ad_bits": 16, "DeviceTotalChannels": 3}
    return encode.encode_otb(header, [({"ID": "A", "Gain": 1, "ChannelStartIndex": 0}, [{"Index": c} for c in range(3)])], LONG, kind)


@pytest.mark.parametrize("kind", ["tar", "zip"])
def test_only_the_bytes_asked_for_are_read(kind):
    file = Counting(long_otb(kind))
    d = otb.decode(file, header_only=True)
    assert (d.n_samples, d.n_channels, d.ranged) == (200_000, 3, True) and file.taken < 20_000
    d = otb.decode(file)
    before = file.taken
    some = d.read(150_000, 100)
    assert file.taken - before < 20_000
    np.testing.assert_array_equal(some, LONG[:, 150_000:150_100] * 4.8 / 2.0**16 * 1000)
    tracks, streams = [track(NumberOfChannels=2), track()], {"a.sig": encode.interleaved(LONG, "<i2")}
    file = Counting(encode.encode_otb4(tracks, streams, kind))
    d = otb4.decode(file, header_only=True)
    assert (d.n_samples, d.ranged) == (200_000, True) and file.taken < 20_000


def test_compressed_archives_are_inflated_in_order():
    found = {"r.sig": encode.interleaved(LONG, "<i2"), "r.xml": Archive(io.BytesIO(long_otb("tar"))).read("rec.xml")}
    deflated = io.BytesIO()
    with zipfile.ZipFile(deflated, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in found.items():
            z.writestr(name, content)
    for content in (deflated.getvalue(), gzip.compress(encode.archive(found))):
        d = otb.decode(content)
        assert not d.ranged
        for start in (0, 70_000, 70_010, 5):
            np.testing.assert_array_equal(d.read(start, 10), LONG[:, start : start + 10] * 4.8 / 2.0**16 * 1000)


def test_recordings_are_read_in_parts(spark, tmp_path, monkeypatch):
    """Each chunk comes once, whatever the number of parts; seconds leave out chunks; compressed files have one part with rows."""
    monkeypatch.setattr(files, "CHUNK", 1000)
    (tmp_path / "a.otb+").write_bytes(long_otb("tar"))
    (tmp_path / "b.otb+").write_bytes(gzip.compress(long_otb("tar")))
    whole = [tuple(r) for r in read_recordings(spark, str(tmp_path)).select("file_name", "channel_idx", "chunk_idx", "start_sample", "samples").collect()]
    monkeypatch.setattr(files, "SPLIT_BYTES", 77_000)
    signals = read_recordings(spark, str(tmp_path), channels=[2])
    parts = signals.where("file_name = 'a.otb+'").selectExpr("spark_partition_id() as p").distinct().count()
    got = [tuple(r) for r in signals.select("file_name", "channel_idx", "chunk_idx", "start_sample", "samples").collect()]
    assert parts > 5 and sorted(got) == sorted(r for r in whole if r[1] == 2) and len(whole) == 2 * 3 * 200
    assert [x for r in sorted(got) if r[0] == "a.otb+" for x in r[4]] == (LONG[2] * 4.8 / 2.0**16 * 1000).tolist()
    some = read_recordings(spark, str(tmp_path), seconds=(50.0, 51.0)).select("chunk_idx").distinct().collect()
    assert sorted(r["chunk_idx"] for r in some) == [102, 103, 104]


def test_recording_above_two_gigabytes(spark, tmp_path):
    """A sparse file of 3 GB: its header and its last samples are read, and nothing between."""
    channels, samples, path = 3, 500_000_000, tmp_path / "big.otb+"
    xml = Archive(io.BytesIO(long_otb("tar"))).read("rec.xml")
    with open(path, "wb") as f:
        for name, size in (("r.xml", len(xml)), ("r.sig", samples * channels * 2)):
            info = tarfile.TarInfo(name)
            info.size = size
            f.write(info.tobuf())
            if name == "r.xml":
                f.write(xml + b"\0" * (-len(xml) % 512))
        f.seek(samples * channels * 2 - 6, os.SEEK_CUR)
        f.write(np.array([7, 8, 9], "<i2").tobytes())
        f.write(b"\0" * (-f.tell() % 512 + 1024))
    assert path.stat().st_size > 3_000_000_000
    assert read_recordings(spark, str(path), header_only=True).first()["n_samples"] == samples
    end = samples / 2048
    last = read_recordings(spark, str(path), seconds=(end - 0.01, end)).orderBy("channel_idx").collect()
    assert [r["samples"][-1] for r in last] == [k * 4.8 / 2.0**16 * 1000 for k in (7, 8, 9)] and {r["chunk_idx"] for r in last} == {samples // files.CHUNK}
    assert {k for p in range(24) for k in files.chunks_of(samples, p, 24, 2048, None)} == set(range(samples // files.CHUNK + 1))


def test_other_stores_are_read_by_spark(spark, tmp_path, monkeypatch):
    (tmp_path / "a.otb+").write_bytes(otb_bytes())
    want = read_recordings(spark, str(tmp_path)).collect()
    monkeypatch.setattr(stores, "SCHEMES", {})
    assert read_recordings(spark, str(tmp_path)).collect() == want
    assert len(read_recordings(spark, str(tmp_path), header_only=True).collect()) == 3


def test_failed_writes_leave_nothing(spark, tmp_path):
    """One bad recording among others: none of the files appears, and no folder of the job stays."""
    for name in "abcdef":
        (tmp_path / f"{name}.otb+").write_bytes(otb_bytes())
    signals = read_recordings(spark, str(tmp_path)).cache()
    (tmp_path / "out").mkdir()
    uneven = signals.where("file_name <> 'c.otb+' or channel_idx > 0").unionByName(signals.where("file_name = 'c.otb+' and channel_idx = 0").selectExpr(*[c for c in signals.columns if c != "samples"], "array(1D) as samples"))
    with pytest.raises(Exception, match="dimension|shape"):
        write_mat_files(uneven, str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []
    assert {r["path"] for r in write_mat_files(signals, str(tmp_path / "out")).collect()} == {str(p) for p in (tmp_path / "out").iterdir()}
    assert len(list((tmp_path / "out").iterdir())) == 6


def test_only_the_attempts_that_count_are_committed(tmp_path):
    """Of two attempts of a task one's message is committed; the other's file goes, and so does what an aborted job left."""
    import pandas as pd
    import pyarrow as pa

    row = {"file_id": "f", "target": str(tmp_path / "t.mat"), "single": False, "sampling_frequency": 2.0, "channel_idx": 0, "description": "d", "chunk_idx": 0, "samples": [1.0, 2.0], "time": None}
    batch = pa.RecordBatch.from_pandas(pd.DataFrame([row]), preserve_index=False)
    writer = mat_sink.MatWriter(5, "job")
    one, other = writer.write(iter([batch])), writer.write(iter([batch]))
    assert one.files[0][0] != other.files[0][0] and not (tmp_path / "t.mat").exists()
    writer.commit([one, None])
    assert [p.name for p in tmp_path.iterdir()] == ["t.mat"]
    writer = mat_sink.MatWriter(4, "again")
    writer.abort([writer.write(iter([batch]))])
    assert [p.name for p in tmp_path.iterdir()] == ["t.mat"]


def test_mat_level_4(spark, tmp_path):
    values = {"Data": np.arange(14, dtype=np.int16).reshape(7, 2), "Time": np.arange(7.0)[:, None] / 50, "Description": ["HD05MM0506", "reference"], "SamplingFrequency": np.array([[50.0]])}
    others = {"f": np.float32([[1.5, 2]]), "i": np.int32([[-3]]), "u": np.uint16([[65535]]), "b": np.uint8([[1], [2]]), "text": "one line", "wide": np.int64([[2**40]]), "empty": np.zeros((0, 3))}
    back = mat.read_mat(mat.write_mat4(values | others))
    for name, x in (values | others).items():
        if isinstance(x, np.ndarray):
            np.testing.assert_array_equal(back[name], x)
        else:
            assert back[name] == x
    assert back["Data"].dtype == np.int16 and back["f"].dtype == np.float32 and mat.read_mat(mat.write_mat4(values), "Data")["Data"] == (7, 2)
    big = mat.struct.pack(">5i", 1010, 1, 2, 1, 2) + b"x\0" + np.array([1, 2, 9, 9], ">f4").tobytes()
    assert mat.read_mat(big)["x"].tolist() == [[1.0, 2.0]]
    for bad in (big[:-1], big[:10], mat.struct.pack("<5i", 3000, 1, 1, 0, 2) + bytes(10), bytes(21)[:19]):
        with pytest.raises(ValueError):
            mat.read_mat(b"\0" * 4 + bad if bad == big[:10] else bad[:-9] if bad == big[:-1] else bad)
    (tmp_path / "four.mat").write_bytes(mat.write_mat4(values))
    (tmp_path / "five.mat").write_bytes(mat.write_mat(values))
    four, five = ([tuple(r)[4:] for r in read_recordings(spark, str(tmp_path / f"{n}.mat")).orderBy("channel_idx").collect()] for n in ("four", "five"))
    assert four == five and len(four) == 2 and four[0][3] is True
    (tmp_path / "out").mkdir()
    (row,) = write_mat_files(read_recordings(spark, str(tmp_path / "four.mat")), str(tmp_path / "out"), level=4).collect()
    assert mat.read_mat(open(row["path"], "rb").read())["Description"] == values["Description"] and open(row["path"], "rb").read(4) != b"MATL"
    assert read_recordings(spark, str(tmp_path), header_only=True).groupBy("file_name").count().count() == 2


def test_stored_time(spark, tmp_path, monkeypatch):
    """An uneven time vector is read, exploded and written back; one as long as there are channels too."""
    monkeypatch.setattr(files, "CHUNK", 3)
    data, times = np.arange(16.0).reshape(8, 2), {"a": np.array([5, 5.5, 7, 9, 9.25, 11, 12, 20.0]), "b": np.arange(8) / 4, "c": np.array([3.0, 4])}
    for name, time_ in times.items():
        (tmp_path / f"{name}.mat").write_bytes(mat.write_mat({"Data": data, "Time": time_[:, None], "SamplingFrequency": np.array([[4.0]])}))
    signals = read_recordings(spark, str(tmp_path / "*.mat"))
    assert signals.count() == 3 * 2 * 3 and signals.where("time is not null").count() == 6 + 2
    for r in layout.explode_samples(signals).collect():
        name, i = r["file_id"][-5], r["sample_idx"]
        assert (r["t"], r["value"]) == (times[name][i] if name == "a" else i / 4, data[i, r["channel_idx"]])
    (tmp_path / "out").mkdir()
    for r in write_mat_files(signals, str(tmp_path / "out")).collect():
        back = mat.read_mat(open(r["path"], "rb").read())
        np.testing.assert_array_equal(back["Time"].ravel(), times[r["path"][-5]])
        np.testing.assert_array_equal(back["Data"], data)


def test_empty_recordings(spark, tmp_path):
    """Without samples, and without channels."""
    (tmp_path / "a.mat").write_bytes(mat.write_mat({"Data": np.zeros((0, 0)), "Time": np.zeros((0, 1))}))
    (tmp_path / "b.otb4").write_bytes(encode.encode_otb4([track()], {"a.sig": b""}))
    (tmp_path / "c.otb4").write_bytes(encode.encode_otb4([track()], {}))
    signals, header = (read_recordings(spark, str(tmp_path), header_only=h) for h in (False, True))
    want = {"a.mat": None, "b.otb4": 0, "c.otb4": None}
    for found in (signals, header):
        assert {r["file_name"]: r["channel_idx"] for r in found.collect()} == want
    assert all(r["samples"] == [] for r in signals.collect())
    (tmp_path / "out").mkdir()
    assert write_mat_files(signals, str(tmp_path / "out")).count() == 3
    assert mat.decode((tmp_path / "out" / "b.mat").read_bytes()).n_samples in (0, 1)


def test_clashing_targets(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.otb+").write_bytes(otb_bytes())
    signals = read_recordings(spark, [str(tmp_path / "x"), str(tmp_path / "y")])
    with pytest.raises(Exception, match="several recordings"):
        write_mat_files(signals, str(tmp_path)).collect()
    assert not (tmp_path / "a.mat").exists()
    with pytest.raises(Exception, match="several recordings"):
        Recording(signals).save(str(tmp_path / "one.mat"))


def test_stream_of_recordings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.otb+").write_bytes(otb_bytes())
    q = stream_recordings(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


#: Two grids with references between them, one product in lower case, and a file without any grid.
CHANNELS = [
    ("f", 0, "temperature"), ("f", 1, "M1 HD05MM0804 a"), ("f", 2, "goniometer"), ("f", 3, "M1 HD05MM0804 b"), ("f", 4, "The Requested Path"), ("f", 5, "M2 hd10mm0808"),
    ("f", 6, "HD20MM0408"), ("f", 7, "performed path of the hand"), ("f", 8, None), ("g", 0, "force"), ("g", 1, None),
]


def test_grids(spark):
    channels = spark.createDataFrame(CHANNELS, "file_id string, channel_idx int, description string")
    catalog = GridCatalog(fetch=lambda: [{"product": "hd20mm0408", "electrodes": 31}]).frame(spark)
    frame = extract_grids(channels, catalog)
    found = {g["grid_key"]: g for g in frame.collect()}
    assert found.keys() == {"8x4", "4x8"} and {g["file_id"] for g in found.values()} == {"f"}
    fields = ["rows", "cols", "ied_mm", "emg_indices", "ref_indices", "requested_path_idx", "performed_path_idx", "first_idx", "electrodes"]
    assert [found["8x4"][x] for x in fields] == [8, 4, 5, [1, 3], [2, 4, 5], 4, None, 1, 32]  # lower case names no product
    assert [found["4x8"][x] for x in fields] == [4, 8, 20, [6], [7, 8], None, 7, 6, 31]
    assert get_grid(frame, grid_key="none", grid_uid=found["4x8"]["grid_uid"]).first()["grid_key"] == "4x8"
    assert get_grid(frame, grid_key="8x4", grid_uid=found["4x8"]["grid_uid"]).first()["grid_key"] == "8x4"
    assert get_grid(frame).count() == 0


def test_catalog_cache(tmp_path):
    path = tmp_path / "cache.json"
    path.write_text(json.dumps([{"product": "HD05MM0707", "electrodes": 48}]))
    fetch = lambda: [{"product": "HD08MM0404", "electrodes": 15}]
    assert GridCatalog(str(path), fetch).entries()[0]["electrodes"] == 48
    os.utime(path, (time.time() - 11 * 86400,) * 2)
    assert GridCatalog(f"file:{path}", fetch).entries()[0]["electrodes"] == 15
    assert json.loads(path.read_text())[0]["electrodes"] == 15
    assert GridCatalog(str(tmp_path / "no" / "x"), lambda: 1 / 0).entries() == []
    path.write_text("[{half")
    assert GridCatalog(str(path), fetch).entries()[0]["electrodes"] == 15


def test_catalog_is_replaced_whole(tmp_path):
    """Many drivers that refresh one cache at once leave one whole file; a reader never sees part of one."""
    from concurrent.futures import ThreadPoolExecutor

    path, n = str(tmp_path / "cache.json"), 3000

    def refresh(k: int) -> set[int]:
        GridCatalog(path, lambda: [{"product": "HD08MM0404", "electrodes": k}] * n, clock=lambda: time.time() + 11 * 86400).entries()
        seen = GridCatalog(path, lambda: 1 / 0).entries()
        assert len(seen) == n
        return {e["electrodes"] for e in seen}

    with ThreadPoolExecutor(8) as pool:
        assert all(len(seen) == 1 for seen in pool.map(refresh, range(40)))
    assert [p.name for p in tmp_path.iterdir()] == ["cache.json"]


def test_layout(spark):
    stream = spark.createDataFrame([(i, i * 10) for i in range(11)], "p int, v int")
    dealt = layout.deinterleave(stream, "p", 11, 3)
    assert dealt.count() == 9
    assert layout.interleave(dealt, 3).where("position <> p").count() == 0
    with pytest.raises(ValueError):
        layout.deinterleave(stream, "p", 11, 0)
    with pytest.raises(ValueError):
        layout.check_divisible(7, 2)
    cells = spark.createDataFrame([("w", r, c) for r in range(2) for c in range(3)] + [("s", r, c) for r in range(2) for c in range(2)], "m string, row_idx int, col_idx int")
    shape = {r["m"]: (r["a"], r["b"]) for r in layout.orient(cells, ["m"]).groupBy("m").agg({"row_idx": "max", "col_idx": "max"}).toDF("m", "a", "b").collect()}
    assert shape["s"] == (1, 1) and sorted(shape["w"]) == [1, 2]


def test_tracks(spark):
    rows = spark.createDataFrame([("f", 0, 2, 0.0), ("f", 1, 0, 5.0), ("f", 2, 3, 9.0)], "file_id string, track_idx int, number_of_channels int, sampling_frequency double")
    assert [(r["low"], r["high"]) for r in track_ranges(rows, ["file_id"]).orderBy("track_idx").collect()] == [(0, 2), (2, 2), (2, 5)]
    assert recording_rate(rows, ["file_id"]).first()["sampling_frequency"] == 2000.0
