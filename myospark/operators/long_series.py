"""Zero-phase bandpass filtering of series that no task needs to hold: a prefix scan over filter states, forwards and then backwards.

A series lies in blocks, in any tasks. Each block gives what it leaves behind in the filter's states (a few numbers); a scan over these, by
series, says from which states each block starts; then all blocks are filtered at once. Backwards the same. What is gathered for a
series is some hundred bytes a block: of a series of 10^10 samples in blocks of 2^16, 60 MB.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from myospark.functions.butterworth import Bandpass, design
from myospark.functions.recurrence import Recurrence, starts
from myospark.session import cut, ensure_workers

#: Of 2^BLOCK_BITS rows of a task, those of one series become a block.
BLOCK_BITS = 16


def summaries(r: Recurrence, values: Column) -> Column:
    """Of each block: its length, what it leaves behind, and its first and last samples, from which the series is extended."""
    p = r.f.pad

    @F.pandas_udf("struct<n:long,left:array<double>,head:array<double>,tail:array<double>>")
    def summary(column: pd.Series) -> pd.DataFrame:
        rows = [np.asarray(x, float) for x in column]
        return pd.DataFrame({"n": [len(x) for x in rows], "left": r.left_by(rows), "head": [x[: p + 1] for x in rows], "tail": [x[-(p + 1) :] for x in rows]})

    return summary(values)


def ends_of(r: Recurrence, n: int, heads: list[np.ndarray], tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The odd extensions of a series of n samples: what stands before and behind it."""
    p = r.f.pad
    if n <= p:
        raise ValueError(f"a series of {n} samples is too short: the filter needs more than {p}")
    head, tail = np.zeros(0), np.zeros(0)
    for x in heads:
        head = np.append(head, x)
        if len(head) > p:
            break
    for x in reversed(tails):
        tail = np.append(x, tail)
        if len(tail) > p:
            break
    tail = tail[-(p + 1) :]
    return 2 * head[0] - head[p:0:-1], 2 * tail[-1] - tail[-2::-1]


def filter_blocks(blocks: DataFrame, keys: list[str], order: str, values: str, f: Bandpass) -> DataFrame:
    """blocks with filtered `values` (array<double>). The blocks of a series share `keys` and are put in order by `order`.

    Nulls in keys count as a value. A series of no more samples than the filter's padding is an error; blocks may be empty. No
    blocks give none. Blocks of equal keys and order are an error, as their order isn't known.
    """
    ensure_workers(blocks.sparkSession)
    r, named = Recurrence(f), [*keys, order]

    @F.pandas_udf("struct<states:array<array<double>>,end:array<double>>")
    def scan_forwards(orders: pd.Series, sizes: pd.Series, left: pd.Series, heads: pd.Series, tails: pd.Series) -> pd.DataFrame:
        """The states before each block of each series, and those before its end when it is filtered backwards."""
        if any(len(set(o)) < len(o) for o in orders.map(list)):
            raise ValueError(f"two blocks of a series have the same {order}")
        before, behind = zip(*(ends_of(r, int(sum(n)), list(h), list(t)) for n, h, t in zip(sizes, heads, tails, strict=True)), strict=True) if len(orders) else ((), ())
        first = r.run(list(before), [r.initial * x[0] for x in before])[1]
        found = [starts(r, list(n), list(e), s) for n, e, s in zip(sizes, left, first, strict=True)]
        beyond = [y[::-1] for y in r.run(list(behind), [end for _, end in found])[0]]
        return pd.DataFrame({"states": [states for states, _ in found], "end": r.run(beyond, [r.initial * x[0] for x in beyond])[1]})

    @F.pandas_udf("array<array<double>>")
    def scan_backwards(sizes: pd.Series, left: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([starts(r, list(n)[::-1], list(e)[::-1], np.asarray(next(x for x in end if x is not None)))[0][::-1] for n, e, end in zip(sizes, left, ends, strict=True)])

    def by_series(rows: DataFrame) -> DataFrame:
        """A row for each series, with its blocks in order."""
        own = [c for c in rows.columns if c not in keys and c != order]
        return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *own))).alias("_b"))

    def joined(rows: DataFrame, states: DataFrame) -> DataFrame:
        to = states.toDF(*(f"_to_{c}" for c in states.columns))
        same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(to[f"_to_{c}"]) for c in named))
        return rows.join(to, same).drop(*(f"_to_{c}" for c in named)).withColumnsRenamed({f"_to_{c}": c for c in ("_state", "_end") if c in states.columns})

    @F.pandas_udf("struct<y:array<double>,left:array<double>>")
    def forwards(column: pd.Series, state: pd.Series) -> pd.DataFrame:
        found, _ = r.run([np.asarray(x, float) for x in column], state.to_list())
        return pd.DataFrame({"y": found, "left": r.left_by([y[::-1] for y in found])})

    @F.pandas_udf("array<double>")
    def backwards(column: pd.Series, state: pd.Series) -> pd.Series:
        return pd.Series([y[::-1] for y in r.run([np.asarray(y, float)[::-1] for y in column], state.to_list())[0]])

    each = by_series(blocks.select(*named, summaries(r, F.col(values)).alias("_s")).select(*named, "_s.*"))
    scanned = each.withColumn("_f", scan_forwards(*(F.col(f"_b.{c}") for c in (order, "n", "left", "head", "tail"))))
    last = F.element_at(f"_b.{order}", -1)
    begin = scanned.select(*keys, last.alias("_last"), "_f.end", F.explode(F.arrays_zip(F.col(f"_b.{order}").alias("o"), F.col("_f.states").alias("s"))).alias("_x"))
    begin = begin.select(*keys, F.col("_x.o").alias(order), F.col("_x.s").alias("_state"), F.when(F.col("_x.o") == F.col("_last"), F.col("end")).alias("_end"))
    forth = cut(joined(blocks, begin).withColumn("_f", forwards(values, "_state")))
    each = by_series(forth.select(*named, F.size("_f.y").cast("long").alias("n"), F.col("_f.left").alias("left"), "_end"))
    scanned = each.withColumn("_s", scan_backwards(*(F.col(f"_b.{c}") for c in ("n", "left", "_end"))))
    back = scanned.select(*keys, F.explode(F.arrays_zip(F.col(f"_b.{order}").alias("o"), F.col("_s").alias("s"))).alias("_x")).select(*keys, F.col("_x.o").alias(order), F.col("_x.s").alias("_state"))
    done = joined(forth.drop("_state", "_end"), back).withColumn(values, backwards("_f.y", "_state"))
    return done.select(*blocks.columns)


def bandpass_long(df: DataFrame, keys: list[str], order_by: list[str], value: str, order: int, low: float, high: float, rate: float) -> DataFrame:
    """(keys, order_by, value, filtered) of series in long form, also of series that are longer than a task's memory.

    Rows are sorted in ranges, and cut into blocks where they lie; a series may go over any number of ranges. Rows of a series that
    agree in order_by are put in order by value.
    """
    f, number = design(order, low, high, rate), F.monotonically_increasing_id()
    rows = df.select(*keys, *order_by, F.col(value).cast("double").alias(value))
    placed = cut(rows.orderBy(*keys, *order_by, value).withColumn("_at", number))
    blocks = placed.groupBy(*keys, F.shiftright("_at", BLOCK_BITS).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_at", *order_by, value))).alias("_rows"))
    done = filter_blocks(blocks.withColumn("_y", F.col(f"_rows.{value}")), keys, "_block", "_y", f)
    each = done.select(*keys, F.explode(F.arrays_zip("_rows", "_y")).alias("_r"))
    return each.select(*keys, *(F.col(f"_r._rows.{c}").alias(c) for c in [*order_by, value]), F.col("_r._y").alias("filtered"))
