"""The shape of recordings: interleaved streams, orientation, time vectors, blocks of unequal length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "sample_idx") -> DataFrame:
    """Positions from 0 in each series. One shuffle by the series' keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def deinterleave(df: DataFrame, position: str, total: int | Column, channels: int) -> DataFrame:
    """channel_idx and sample_idx of a stream whose positions run through all channels, then on; a partial last sample goes.

    total: the values of the stream, a number or a column.
    """
    if channels < 1:
        raise ValueError(f"a stream needs channels, not {channels}")
    p = F.col(position)
    whole = total - total % channels
    return df.where(p < whole).withColumns({"channel_idx": (p % channels).cast("int"), "sample_idx": F.expr(f"`{position}` div {channels}")})


def interleave(df: DataFrame, channels: int) -> DataFrame:
    """The position of each (channel_idx, sample_idx): deinterleave, back."""
    return df.withColumn("position", F.col("sample_idx") * channels + F.col("channel_idx"))


def check_divisible(total: int, channels: int) -> int:
    """Samples a channel of a standard OTB4 stream."""
    if channels < 1 or total % channels:
        raise ValueError(f"{total} values can't be dealt to {channels} channels")
    return total // channels


def orient(df: DataFrame, keys: list[str], row: str = "row_idx", col: str = "col_idx") -> DataFrame:
    """Swap rows and columns of those matrices that have fewer rows than columns; square and tall ones stay."""
    shape = df.groupBy(*keys).agg((F.max(row) < F.max(col)).alias("_wide"))
    r, c = F.col(row), F.col(col)
    return df.join(shape, keys).withColumns({row: F.when(F.col("_wide"), c).otherwise(r), col: F.when(F.col("_wide"), r).otherwise(c)}).drop("_wide")


def check_time(length: int, n_samples: int, n_channels: int) -> bool:
    """Whether a time vector is aligned with the samples. One as long as there are channels is let through, not aligned."""
    if length not in (n_samples, n_channels):
        raise ValueError(f"a time vector of {length} fits neither {n_samples} samples nor {n_channels} channels")
    return length == n_samples


def stack_shortest(df: DataFrame, block: str, order: list[str]) -> DataFrame:
    """Rows of all blocks, numbered, each block cut to the length of the shortest."""
    numbered = number_rows(df, [block], order)
    shortest = df.groupBy(block).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("_n"))
    return numbered.join(F.broadcast(shortest), F.col("sample_idx") < F.col("_n")).drop("_n")  # one row


def channel_count(signals: DataFrame, keys: list[str], channel: str = "channel_idx") -> DataFrame:
    return signals.groupBy(*keys).agg(F.count_distinct(channel).alias("channel_count"))


def explode_samples(signals: DataFrame) -> DataFrame:
    """A row for each sample of chunked signals, with its time: the stored one where it is aligned, or that of the rate."""
    rows = signals.select("file_id", "channel_idx", "description", "sampling_frequency", "start_sample", F.when(F.col("time_aligned"), F.col("time")).alias("time"), F.posexplode("samples").alias("_at", "value"))
    at = F.col("start_sample") + F.col("_at")
    t = F.coalesce(F.get("time", F.col("_at")), at / F.col("sampling_frequency"))
    return rows.select("file_id", "channel_idx", "description", at.alias("sample_idx"), t.alias("t"), "value")
