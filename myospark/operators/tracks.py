"""Tracks of OTB4 recordings: which channels are whose, and which stream is described by which track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a side of a block of pairs, about; pairs that one task compares, about; tasks, at most; keys with several blocks are broadcast up to this number.
SIDE, TASK_PAIRS, MOST_TASKS, BROADCAST_KEYS = 2048, 1 << 26, 100_000, 100_000


def track_ranges(tracks: DataFrame, keys: list[str], order: str = "track_idx", size: str = "number_of_channels") -> DataFrame:
    """tracks with low and high: track i owns channels low <= c < high of its recording."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return tracks.withColumn("high", F.sum(size).over(w)).withColumn("low", F.col("high") - F.col(size))


def track_channels(tracks: DataFrame, keys: list[str], order: str = "track_idx", size: str = "number_of_channels") -> DataFrame:
    """A row for each channel with its track; local_idx starts again at 0 in each track.

    The range join as a generator: each track lists its own channels, so nothing is compared.
    """
    ranged = track_ranges(tracks, keys, order, size).where(F.col(size) > 0)
    listed = ranged.withColumn("channel_idx", F.explode(F.sequence(F.col("low"), F.col("high") - 1)))
    return listed.withColumn("local_idx", F.col("channel_idx") - F.col("low")).drop("low", "high")


def interval_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str = "low", high: str = "high") -> DataFrame:
    """Rows of points with each of the ranges of their keys that holds them: low <= at < high, whole numbers. Both have other names but for the keys.

    Ranges may overlap and leave gaps. A range of up to 2^k lies in one or two bins of 2^k, and is copied to these; a point is copied for each k that
    some range has (at most 64), and looks into its own bin. So the join is one on equal keys, and neither long nor short ranges make many copies.
    Empty ranges and nulls match nothing. Where bins make many pairs, they are cut into blocks (`dealt`), so that tasks are bounded however few the keys.
    """
    some = ranges.where(F.col(low) < F.col(high)).withColumn("_level", F.ceil(F.log2((F.col(high) - F.col(low)).cast("double"))).cast("int"))
    levels = sorted(r["_level"] for r in some.select("_level").distinct().collect())
    bin_of = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    binned = some.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(low)), bin_of(F.col(high) - 1))))
    looked = points.withColumn("_level", F.explode(F.lit(levels).cast("array<int>"))).withColumn("_bin", bin_of(F.col(at)))
    left, right, on = dealt(looked, binned, [*keys, "_level", "_bin"])
    met = left.join(right, on)
    return met.where((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))).drop("_level", "_bin", "_row", "_column")


def dealt(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an inner join on keys and the columns to join them on, so that no task has much more than TASK_PAIRS pairs.

    A key's pairs are a rectangle of blocks of about SIDE rows by SIDE rows; rows are dealt to its rows and columns by hash, and copied to all blocks there.
    So copies are a 2 / SIDE of the pairs, and each pair meets in one block. Tasks hold blocks of many keys. Equal rows lie in the same blocks.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_columns")), keys)
    pairs = counts.agg(F.sum(F.col("_rows").cast("double") * F.col("_columns"))).first()[0] or 0
    if pairs <= TASK_PAIRS:
        return left, right, keys
    large = counts.where(F.greatest("_rows", "_columns") > SIDE).withColumns({c: F.ceil(F.col(c) / SIDE) for c in ("_rows", "_columns")})
    large = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large
    tasks = int(min(MOST_TASKS, max(pairs // TASK_PAIRS + 1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))))

    def placed(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        hashed = F.xxhash64(*(F.col("`" + c.replace("`", "``") + "`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind))
        sized = df.join(large, keys, "left").withColumn(own, F.pmod(hashed, F.coalesce(own_n, F.lit(1))))
        copied = sized.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other_n, F.lit(1)) - 1)))
        return copied.drop("_rows", "_columns").repartition(tasks, *keys, "_row", "_column")

    return placed(left, "_row", "_rows", "_column", "_columns"), placed(right, "_column", "_columns", "_row", "_rows"), [*keys, "_row", "_column"]


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str], how: str = "inner") -> DataFrame:
    """Join each row of left with the first row of right, in this order, that has its key."""
    first = right.withColumn("_n", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).where("_n = 1").drop("_n")
    return left.join(first, on, how)


def recording_rate(tracks: DataFrame, keys: list[str], order: str = "track_idx", rate: str = "sampling_frequency") -> DataFrame:
    """The first track's rate; 0 and null become 2000."""
    first = F.min_by(F.col(rate), F.col(order))
    return tracks.groupBy(*keys).agg(F.coalesce(F.nullif(first, F.lit(0.0)), F.lit(2000.0)).alias(rate))
