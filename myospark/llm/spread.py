"""Rows that are told apart by a number, tables written for reuse, and joins on keys that are unevenly held."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from myospark.session import ensure_checkpoints, release

#: Keys that hold more than LEAST rows are dealt over several tasks, the MOST largest of them; any other key holds less
#: than one row in MOST. Their list is broadcast (MOST rows at most).
MOST, LEAST = 10_000, 1_000
#: Ids and classes are broadcast up to this number (50 bytes each at most); beyond it they are joined by shuffling.
BROADCAST_ROWS = 500_000

_open: list[list[str]] = []


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def tables(made: list[str]) -> Iterator[None]:
    """made: gets the folders of the tables that are written inside."""
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)


def written(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared checkpoint folder: later reads take only the columns they need.

    Like a checkpoint's files, the table stays until that folder is cleared, or until who asked for its name (`tables`) removes it.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    release(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    for made in _open:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row, written, so that a row keeps its number however often it is read."""
    return written(df.withColumn(name, F.monotonically_increasing_id()))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def join_dealt(rows: DataFrame, table: DataFrame, keys: list[str], n: str, by: Column, how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row for each key and in `n` how many rows hold it.

    The rows of a key that many hold are dealt by hash of `by`, and the table's row is sent to each deal.
    """
    held = table.where(F.col(n) > LEAST).orderBy(F.desc(n), *keys).limit(MOST)
    hot = F.broadcast(held.select(*keys, F.ceil(F.col(n) / LEAST).cast("int").alias("_parts")))
    dealt = rows.join(hot, keys, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"))).drop("_parts")
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    copied = table.join(hot, keys, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")


def without(df: DataFrame, lost: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is in lost (distinct keys)."""
    return df.join(small(lost), key, "left_anti")
