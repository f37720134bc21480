"""What Python workers hold: pieces of texts, counts, and what is kept from task to task."""

from __future__ import annotations

import random
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from myospark import session
from myospark.llm import decontamination, linear, linejoin, nearcopies, spread, toxicity
from myospark.llm.words import pieces


def test_search_holds_little_memory():
    """A worker that searches 2 MB of texts for benchmark items holds arrays for a quarter of a megabyte of them."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    benchmark = [some(rng.randrange(20, 60)) for _ in range(200)]
    texts = pa.array([some(150) + " " + benchmark[i % 200] + " " + some(150) for i in range(1200)])
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    items = decontamination.Items([(i, decontamination.text_words(t).view(np.int64)) for i, t in enumerate(benchmark)], none)
    vectors = np.random.default_rng(5).standard_normal((decontamination.BUCKETS, decontamination.DIMENSIONS)).astype(np.float32)
    items.project(vectors)
    tracemalloc.start()
    found = set()
    for begin, data, offsets in pieces(texts, decontamination.SEARCHED):
        found |= {(begin + t, p) for t, p in items.find(*decontamination.words_of(data, offsets), vectors)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(i, i % 200) for i in range(1200)} <= found
    assert texts.nbytes > 2 << 20 and peak < 24 << 20


def test_features_counted_in_parts(spark, monkeypatch):
    """Counts that are sent before a task's end add up to the same features."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["bad", "worse"] if i % 3 == 0 else ["good", "fine"], k=2) + rng.choices([f"word{j}" for j in range(300)], k=20)), int(i % 3 == 0)) for i in range(300)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int").coalesce(1)
    session.ensure_workers(spark)
    at_once = linear.chosen(sample, ["toxic"], toxicity.word_features, toxicity.no_features)
    monkeypatch.setattr(linear, "COUNTED", 50)
    assert linear.chosen(sample, ["toxic"], toxicity.word_features, toxicity.no_features) == at_once
    assert {"w:bad", "w:worse", "w:good", "w:fine"} <= set(at_once)


def test_texts_of_prefixes_are_sent_by_megabytes(spark, monkeypatch):
    """Prefixes are taken with batches of many rows, which may not hold a whole partition's texts."""
    def batches(self, texts, plain=nearcopies.Shingles.batches):
        if len(texts) and texts.nbytes > 6 << 20:
            raise ValueError("too many texts at once")
        return plain(self, texts)

    monkeypatch.setattr(nearcopies.Shingles, "batches", batches)
    rng = random.Random(7)
    texts = [" ".join(f"word{rng.randrange(10**6)}" for _ in range(400)) for _ in range(3000)]
    texts += [texts[0] + " more", texts[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    kept = {r["doc_id"] for r in nearcopies.keep_one(docs).select("doc_id").collect()}
    assert sum(map(len, texts)) > 12 << 20 and kept == set(range(3000))


def test_what_is_kept_between_tasks():
    one = session.kept("one", list)
    assert session.kept("one", list) is one
    session.give_back("one")
    assert session.kept("one", list) is one
    session.give_back()
    assert session.kept("one", list) is not one
    two = session.kept("two", list)
    assert session.kept("one", list) is not two and session.kept("two", list) is not two
    session.give_back()


def test_wide_sketches_are_folded_when_asked(monkeypatch):
    """Postings of long lines stay in Arrow, and as few sketches are folded as pairs pass the other filters; links are those of plain pairs."""
    rng = np.random.default_rng(8)
    rows, lists = 40_000, 8_000
    key, n, width = np.sort(rng.integers(0, lists, rows)), rng.integers(200, 400, rows).astype(np.int32), rng.choice([8, 16], rows)
    base = rng.integers(0, 1 << 63, (lists, 18))
    noise = np.where(rng.random(rows) < 0.02, 0, 1)[:, None] * rng.integers(0, 1 << 63, (rows, 18))  # of a list, a few rows are alike
    bits = base[key] ^ noise
    wide = [b[2 : 2 + w] for b, w in zip(bits, width, strict=True)]
    wide = pa.ListArray.from_arrays(np.append(0, np.cumsum(width)).astype(np.int32), pa.array(np.concatenate(wide)))
    columns = {"key": key << linejoin.POSITION_BITS, "id": np.arange(rows), "n": n, "sketch0": bits[:, 0], "sketch1": bits[:, 1]}
    table = pa.table({k: pa.array(v) for k, v in columns.items()} | {"wide": wide})
    monkeypatch.setattr(linejoin, "BUFFER", rows // 4)
    tracemalloc.start()
    found = pa.Table.from_batches(list(linejoin.join_postings(iter(table.to_batches(1000)))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    root = {i: i for i in range(rows)}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    def fold(x, k):
        while len(x) > k:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        return x

    linked, sketches = [], wide.to_pylist()
    for a, b in ((i, j) for i in range(rows) for j in range(i + 1, min(i + 60, rows)) if key[i] == key[j]):
        total, k = int(n[a]) + int(n[b]), min(width[a], width[b])
        if 9 * min(n[a], n[b]) < 4 * total or 9 * int(np.bitwise_count(bits[a, :2] ^ bits[b, :2]).sum()) > total:
            continue
        if 9 * int(np.bitwise_count(fold(np.array(sketches[a]), k) ^ fold(np.array(sketches[b]), k)).sum()) <= total:
            linked.append((a, b))
    got = list(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))
    assert np.bincount(key).max() < 60 and got and {tuple(sorted(p)) for p in got} <= set(linked)
    for a, b in got:
        root[top(a)] = top(b)
    assert all(top(a) == top(b) for a, b in linked)
    assert peak < 8 << 20


def test_shuffles_of_earlier_steps_go_as_tables_are_written(spark):
    """What a step has shuffled is removed with the second table after it at the latest, though the driver's heap has room for its plan."""
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    held = lambda: int(tracker.shuffleStatuses().size())
    before = held()
    for i in range(8):
        spark.range(100).repartition(3).groupBy((F.col("id") % (i + 2)).alias("k")).count().collect()
    assert held() >= before + 8
    for table in (session.cut, spread.written):
        table(spark.range(10))
        time.sleep(3)  # Python tells the JVM of dropped frames by and by
    assert held() <= before


def test_driver_returns_native_memory(spark):
    assert session.trim(spark).startswith("Trim native heap")


def test_stages_remove_the_tables_of_those_before(spark):
    """What a stage has written for itself goes when the next one begins, but for what the next one still reads."""
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    there = lambda: {x.name for x in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("table-*")}
    docs = spark.createDataFrame([(i, f"line {i} of {i % 7} words\nsame line in all of them\nown{i} a{i} b{i} c{i}", "en", "s", 0) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    session.ensure_checkpoints(spark)
    p.clear(spark)
    before = there()
    lazy = stages["line_dedup"](spark, docs, "")
    first = there() - before
    kept = stages["simhash"](spark, lazy, "")  # not written: what it reads stays
    assert len(first) == 3 and first <= there()
    assert kept.count() == 40 and lazy.count() == 40
    path = f"{spark.sparkContext.getCheckpointDir()}/kept-copies"
    kept.write.mode("overwrite").parquet(path)
    p.clear(spark, spark.read.parquet(path))
    assert there() <= before
