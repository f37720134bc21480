"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key and the number of shards alone decide a row's shard; no ring table is kept. When shards are
appended, a row either stays or moves into a new shard.

Nulls: a null key counts as 0; a null text as an empty one. Rows that share a key share a shard; they get slots by checksum and size, and
rows that agree in all of these get slots of their own, in any order. Of a text only its length and checksum are taken, by Spark, so that
texts of any length are never held in Python. An empty table gives an empty table. Columns with the names of the results are replaced;
others are carried along, or ignored by the report.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from myospark.session import cut, ensure_workers

#: Fixed value of the published algorithm.
MULTIPLIER = np.uint64(2862933555777941757)
#: Slots are numbered in ranges of about this many keys, of which there are at most MOST_RANGES.
RANGE_ROWS, MOST_RANGES = 200_000, 4096
#: Rows of one key are dealt by this many leading bits of their checksum where one key fills whole ranges.
HOT_BITS = 8


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards 0 to shards - 1 of 64-bit keys."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    key = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    last, jump = np.full(key.shape, -1, np.int64), np.zeros(key.shape, np.int64)
    while (going := np.flatnonzero(jump < shards)).size:
        last[going] = jump[going]
        key[going] = key[going] * MULTIPLIER + np.uint64(1)
        draw = (key[going] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[going] = ((last[going] + 1) * (float(1 << 31) / draw)).astype(np.int64)
    return last


def shard_of(key: Column, shards: int) -> Column:
    """The shard of an integer key. For text keys, hash them first: shard_of(F.xxhash64(key), n)."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards))

    return jump(F.coalesce(key.cast("long"), F.lit(0)))


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: int = 8) -> DataFrame:
    """docs with `shard`, and `grown_shard`: the same with one shard more. Narrow: no shuffle."""
    ensure_workers(docs.sparkSession)
    return docs.withColumns({"shard": shard_of(F.col(key), shards), "grown_shard": shard_of(F.col(key), shards + 1)})


def number_slots(rows: DataFrame, key: str = "doc_id", checksum: str = "text_crc32") -> DataFrame:
    """Add `slot`: in each `shard`, gapless from 0, by key and then the other columns.

    No task sees a whole shard: shards are cut into key ranges, the ranges counted, and rows numbered inside a range
    from where the ranges before it end. Equal rows are counted first and spread out again at the end. A key that
    fills whole ranges by itself gets ranges of its own by checksum.
    """
    spark, columns = ensure_workers(rows.sparkSession), rows.columns
    low = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    n = max(1, min(MOST_RANGES, -(-rows.count() // RANGE_ROWS)))
    edges = rows.agg(F.percentile_approx(low, [i / n for i in range(n + 1)], 20 * n).alias("x")).first()["x"] or [0]
    values, times = np.unique(np.array(edges, np.int64), return_counts=True)
    hot = [*map(int, values[times > 1])] + [-(1 << 63)]

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(values, k := keys.to_numpy(), "left")
        return pd.Series((2 * at + (values[np.minimum(at, len(values) - 1)] == k)).astype(np.int32))

    own = F.when(low.isin(hot), F.shiftright(F.col(checksum), 32 - HOT_BITS)).otherwise(F.lit(0))
    counted = cut(
        rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_range": range_of(low), "_own": own.cast("int"), "_low": low})
    )
    place = ["shard", "_range", "_own"]
    ranges = counted.groupBy(*place).agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_range", "_own").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    rest = sorted(set(columns) - {"shard", key, checksum})
    inside = Window.partitionBy(*place).orderBy("_low", checksum, *rest).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, place)
    first, step = F.col("_start") + F.col("_at"), 4096
    chunks = placed.withColumn("_from", F.explode(F.sequence(first, first + F.col("_n") - 1, F.lit(step)))).withColumn("_end", first + F.col("_n"))
    return chunks.select(*columns, F.explode(F.sequence("_from", F.least(F.col("_from") + step, F.col("_end")) - 1)).alias("slot"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = 8, parts: int = 16) -> None:
    """Write Parquet folders shard=0, shard=1 and so on; each shard is written by `parts` tasks."""
    sharded = assign_shards(docs, key, shards).drop("grown_shard")
    sharded.repartition(shards * parts, "shard", F.pmod(F.xxhash64(key), F.lit(parts))).write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    small = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"),
    )
    return number_slots(assign_shards(small, "doc_id", shards)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


#: The shard of a key by the published loop, over 128-bit integers; CRC-32 byte by byte.
ORACLE_SQL = """
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
small AS (
  SELECT doc_id, (coalesce(strlen(text), 0) + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table),
jump AS (
  SELECT n, doc_id, coalesce(doc_id, 0)::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (8), (9)) AS s(n)
  UNION ALL
  SELECT n, doc_id, (k * 2862933555777941757 + 1) % 18446744073709551616, j,
    floor((j + 1) * (2147483648::DOUBLE / (((k * 2862933555777941757 + 1) % 18446744073709551616 // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM jump WHERE j < n),
shards AS (SELECT doc_id, max(b) FILTER (n = 8)::INTEGER AS shard, max(b) FILTER (n = 9)::INTEGER AS grown_shard FROM jump GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM small JOIN shards USING (doc_id)
"""
