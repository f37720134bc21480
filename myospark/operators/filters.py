"""Differences of adjacent channels, and zero-phase bandpass filtering, over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from myospark.functions.butterworth import design, zero_phase
from myospark.operators.long_series import filter_blocks
from myospark.session import ensure_workers


def bandpass_arrays(samples: Column, order: int, low: float, high: float, rate: float) -> Column:
    """Filtered arrays of doubles. The filter is designed once; a task filters all series of an Arrow batch together."""
    f = design(order, low, high, rate)

    @F.pandas_udf("array<double>")
    def filtered(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in it:
            some = [i for i, r in enumerate(rows) if r is not None]
            out: list = [None] * len(rows)
            for i, y in zip(some, zero_phase([np.asarray(rows.iloc[i], float) for i in some], f), strict=True):
                out[i] = y
            yield pd.Series(out)

    return filtered(samples)


def bandpass(df: DataFrame, keys: list[str], order_by: list[str], value: str, order: int, low: float, high: float, rate: float) -> DataFrame:
    """(keys, order_by, value, filtered) of series in long form: a series is the rows of a key. One shuffle by the keys.

    A task holds a whole series; `long_series.bandpass_long` gives the same for series of any length.
    """
    ensure_workers(df.sparkSession)
    item = F.struct(*[F.col(c) for c in order_by], F.col(value).cast("double").alias(value))
    series = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_rows"))
    done = series.withColumn("_y", bandpass_arrays(F.col(f"_rows.{value}"), order, low, high, rate))
    return done.select(*keys, F.explode(F.arrays_zip("_rows", "_y")).alias("_r")).select(*keys, "_r._rows.*", F.col("_r._y").alias("filtered"))


def bandpass_signals(signals: DataFrame, order: int, low: float, high: float, rate: float) -> DataFrame:
    """Filtered chunked signals. A channel's chunks may lie in any tasks, however many they are: only filter states are gathered."""
    return filter_blocks(signals, ["file_id", "channel_idx"], "chunk_idx", "samples", design(order, low, high, rate))


def differential_raw(df: DataFrame, matrix: str, channel: str, sample: str, value: str) -> DataFrame:
    """Long form: each channel's value less that of the channel before it, at the same sample."""
    before = F.lag(value).over(Window.partitionBy(matrix, sample).orderBy(channel))
    rank = F.row_number().over(Window.partitionBy(matrix, sample).orderBy(channel))
    return df.withColumns({"raw": F.col(value).cast("double") - before.cast("double"), "diff_idx": rank - 2}).where("diff_idx >= 0").drop(value)


def differential_arrays(df: DataFrame, matrix: str, channel: str, samples: str) -> DataFrame:
    """(matrix, diff_idx, raw) of rows that hold a channel's samples as an array: one row a channel is moved, not one a sample."""
    w = Window.partitionBy(matrix).orderBy(channel)
    rows = df.select(matrix, channel, F.col(samples).cast("array<double>").alias("_x")).withColumns({"_before": F.lag("_x").over(w), "diff_idx": F.row_number().over(w) - 2})
    return rows.where("diff_idx >= 0").select(matrix, channel, "diff_idx", F.zip_with("_x", "_before", lambda a, b: a - b).alias("raw"))


def check_matrices(df: DataFrame, matrix: str) -> None:
    """Errors of to_differential: no matrix, fewer than two channels, unequal numbers of channels."""
    n = df.groupBy(matrix).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    if n["least"] is None:
        raise ValueError("there is no matrix")
    if n["least"] < 2:
        raise ValueError("a matrix needs two channels or more")
    if n["least"] != n["most"]:
        raise ValueError(f"matrices have {n['least']} to {n['most']} channels; all must have as many")


def to_differential(df: DataFrame, matrix: str, channel: str, samples: str, rate: float, spec: dict) -> DataFrame:
    """(matrix, channel, diff_idx, raw, filtered): differences of adjacent channels, and those filtered. spec: n, low, up."""
    ensure_workers(df.sparkSession)
    order, low, high = int(spec["n"]), spec["low"], spec["up"]
    check_matrices(df, matrix)
    rows = differential_arrays(df, matrix, channel, samples)
    return rows.withColumn("filtered", bandpass_arrays(F.col("raw"), order, low, high, rate))
