"""Target-distribution importance resampling over hashed n-grams (Xie et al., 2023).

Words: A-Z in lower case, runs of letters, digits and non-ASCII characters. Features: all runs of 1 to 3 consecutive words, joined by
one space; a feature's bucket is the CRC-32 of its bytes modulo BUCKETS. A bucket's gain is the floor of 1000 times the log ratio
of its smoothed shares in the target and in the documents; a document's weight is the sum of gains of its features.

Two passes over Arrow batches. The first counts each partition's features in one vector of BUCKETS numbers, and a tree of
reductions adds these up, so that neither a task nor the driver holds many of them. The second gathers gains, which are broadcast (80 kB),
and sums them by document. The highest scores, weight plus Gumbel noise of the id, are a sample without replacement in proportion
to exponentiated weights. Ranks come from a sort in ranges and their counts: no task sees all rows.

A null text has no features: weight 0, never drawn. A null doc_id is noised like the empty string and comes last among equal
scores. Repeated rows are rows of their own; those that tie fully are ranked in a fixed but arbitrary order. Long texts are read whole, in
windows of about WINDOW bytes. An empty table of documents gives an empty table; without target texts all buckets have a target count of 0.
Columns other than the id and the text may have any names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from myospark.llm.spread import fresh, numbered, written
from myospark.llm.words import LETTERS, pieces
from myospark.session import ensure_workers

BUCKETS, SEED = 10_000, 42
#: Documents of fewer words are never drawn; of the others, this many in a hundred are.
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of a long text that are looked at together, about; words of more bytes are hashed one by one.
WINDOW, LONG = 1 << 20, 48
#: Vectors that are added up by one task of the tree, about.
FAN_IN = 32
#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)

SCORED = "row long, doc_id long, n_features long, weight long, score long"


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


TABLE = crc_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bounds(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop in data; none goes over an edge."""
    word = LETTERS[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    begins[edges], ends[edges - 1] = word[edges], word[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class Extend:
    """CRC-32 of many texts, each lengthened by one of the words data[start:stop], whose bytes are gathered once."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        self.data, self.starts, self.stops = data, starts, stops
        sizes = stops - starts
        self.long = np.flatnonzero(sizes > LONG)
        short = np.where(sizes > LONG, 0, sizes).astype(np.int8)
        self.order = np.argsort(-short, kind="stable")
        at, more = starts[self.order], np.cumsum(np.bincount(short, minlength=1)[::-1])[::-1][1:]
        self.columns = [data[at[:m] + j] for j, m in enumerate(more.tolist())]

    def __call__(self, crc: np.ndarray) -> np.ndarray:
        state = crc[self.order] ^ ONES
        for column in self.columns:
            s = state[: len(column)]
            s[:] = TABLE[(s ^ column) & np.uint32(255)] ^ (s >> np.uint32(8))
        out = np.empty(len(crc), np.uint32)
        out[self.order] = state ^ ONES
        for i in self.long.tolist():
            out[i] = zlib.crc32(self.data[self.starts[i] : self.stops[i]], int(crc[i]))
        return out


def after_space(crc: np.ndarray) -> np.ndarray:
    """The CRC-32 of each text's predecessor in the array with a space behind it; the first has none."""
    s = crc[:-1] ^ ONES
    return np.append(np.zeros(1, np.uint32), TABLE[(s ^ np.uint32(32)) & np.uint32(255)] ^ (s >> np.uint32(8)) ^ ONES)


def grams(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, texts: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each feature that ends in a word behind the first `known` ones."""
    rows, found, crc = [], [], np.zeros(len(starts), np.uint32)
    extend = Extend(data, starts, stops)
    for n in range(3):
        if len(starts) <= n:
            break
        crc = extend(after_space(crc) if n else crc)
        some = np.arange(max(n, known), len(starts))
        some = some[texts[some] == texts[some - n]]
        rows.append(texts[some])
        found.append(crc[some] % np.uint32(BUCKETS))
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.uint32), *found])


def window_end(data: np.ndarray, at: int) -> int:
    """The first place from `at` on that is inside no word."""
    while at < len(data):
        gaps = np.flatnonzero(~LETTERS[data[at : at + 4096]])
        if len(gaps):
            return at + int(gaps[0])
        at += 4096
    return len(data)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of its text, bucket) of the features of all texts, some at a time."""
    for first, data, offsets in pieces(texts):
        data = LOWER[data]
        if len(data) <= 2 * WINDOW or len(offsets) > 2:
            edges = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
            starts, stops = bounds(data, edges)
            rows, found = grams(data, starts, stops, np.searchsorted(offsets, starts, "right") - 1, 0)
            yield first + rows, found
            continue
        begin, end = np.zeros(0, np.int64), 0
        last_starts, last_stops = begin, begin
        while end < len(data):
            at, end = end, window_end(data, min(end + WINDOW, len(data)))
            starts, stops = bounds(data[at:end], np.zeros(0, np.int64))
            known = len(last_starts)
            starts, stops = np.append(last_starts, at + starts), np.append(last_stops, at + stops)
            rows, found = grams(data, starts, stops, np.zeros(len(starts), np.int64), known)
            yield first + rows, found
            last_starts, last_stops = starts[-2:], stops[-2:]


def count_features(texts: DataFrame) -> np.ndarray:
    """How many features of all texts (the only column) are in each bucket: a vector of each partition, added up by a tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, found in features(b.column(0)):
                total += np.bincount(found, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = ensure_workers(texts.sparkSession).sparkContext.union(
        [
            texts.mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64)),
            texts.sparkSession.sparkContext.parallelize([np.zeros(BUCKETS, np.int64)], 1),  # there may be no partition
        ]
    )
    return vectors.treeReduce(np.add, max(2, math.ceil(math.log(vectors.getNumPartitions(), FAN_IN))))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(source, target, strict=True)], np.float64)


def noise(doc_id: int | None) -> int:
    """Gumbel noise in thousandths, the same for an id each time."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def text_column(text: str) -> Column:
    return F.col(text).cast("binary").alias("text")


def score_rows(rows: DataFrame, target: DataFrame, row: str, text: str = "text", target_text: str = "text") -> DataFrame:
    """(SCORED) of rows with a number `row`: features, weight and score of each. Written."""
    spark = ensure_workers(rows.sparkSession)
    gain = spark.sparkContext.broadcast(gains(count_features(rows.select(text_column(text))), count_features(target.select(text_column(target_text)))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, weight = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for at, found in features(b.column(2)):
                n += np.bincount(at, minlength=b.num_rows)
                weight += np.bincount(at, gain.value[found], b.num_rows)
            weight = weight.astype(np.int64)
            own = weight + np.fromiter((noise(i) for i in b.column(1).to_pylist()), np.int64, b.num_rows)
            columns = [b.column(0), b.column(1), pa.array(n.astype(np.int64)), pa.array(weight), pa.array(own)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORED.split(", ")])

    return written(rows.select(row, F.col("doc_id").cast("long").alias("doc_id"), text_column(text)).mapInArrow(score, SCORED))


def rank_rows(scored: DataFrame, percent: float = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with `rank`: 1, 2, 3 for the highest scores among rows of enough words, null for all that aren't drawn.

    Only rows above a quantile that is surely below the last drawn one are sorted: in ranges, by score, id and row. A range's rows are
    numbered from where the ranges before it end; how many rows each range has is all that the driver sees.
    """
    enough = F.col("n_features") >= sum(max(0, least_words - n) for n in range(3))
    n, least = scored.where(enough).agg(F.count(F.lit(1)), F.percentile_approx("score", max(0.0, 1 - percent / 100 - 0.001), 10_000)).first()
    drawn = math.floor(percent * n / 100)
    top = enough & (F.col("score") >= F.lit(least)) if drawn else F.lit(False)
    ordered = scored.where(top).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    placed = written(ordered.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes, starts, start = dict(placed.groupBy("_range").count().collect()), [], 0
    for k in sorted(sizes):
        starts.append((k, start))
        start += sizes[k]
    begins = scored.sparkSession.createDataFrame(starts, "_range int, _start long")
    rank = F.col("_start") + F.col("_at") + 1
    ranked = placed.join(F.broadcast(begins), "_range").select(*scored.columns, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.union(scored.where(~top).select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def importance_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs."""
    rows = docs.withColumn(row := fresh(docs, "_row"), F.monotonically_increasing_id())
    scored = score_rows(rows, target, row)
    return rank_rows(scored).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: float = PERCENT, text: str = "text", target_text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs that are drawn, with all their columns, and their rank in the column `rank` (or `rank_`, where docs has one)."""
    row, rank = fresh(docs, "_row"), fresh(docs, "rank")
    rows = numbered(docs, row)
    drawn = rank_rows(score_rows(rows, target, row, text, target_text), percent, least_words).where(F.col("rank").isNotNull())
    return rows.join(drawn.select(F.col("row").alias(row), F.col("rank").alias(rank)), row).drop(row)


#: The same features and formulas; CRC-32 byte by byte, once for each distinct feature.
ORACLE_SQL = r"""
WITH crc_table AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
texts AS (
  SELECT row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
listed AS (
  SELECT row, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words),
grams AS MATERIALIZED (SELECT row, f, count(*) AS n FROM listed GROUP BY row, f),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM grams), crc_table),
counted AS (SELECT row, bucket, n FROM grams JOIN hashed USING (f)),
sums AS (SELECT b.bucket, coalesce(sum(n) FILTER (row > 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (row < 0), 0)::DOUBLE AS t FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN counted USING (bucket) GROUP BY b.bucket),
totals AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM sums),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000)))) AS gain FROM sums, totals),
weighed AS (SELECT row, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN gains USING (bucket) WHERE row > 0 GROUP BY row),
scored AS (
  SELECT w.row, w.doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM words w LEFT JOIN weighed USING (row) WHERE w.row > 0),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (row)
"""
