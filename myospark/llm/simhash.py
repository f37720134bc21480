"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh, 2016).

Each of 64 bit positions gets a vector of r + 1 bits. For each non-zero vector v of r + 1 bits there is a mask of the
positions whose vector has an odd product with v. The differing positions of a pair within radius r span at most r
dimensions, so some v is orthogonal to all of them: under its mask the pair agrees. So 2^(r+1) - 1 tables, keyed by masked
fingerprints, hold every such pair in one bucket, and no pair is lost.

Buckets hold distinct fingerprints only, so copies count once. A bucket above LARGE is dealt again, by masks over the
bits that its own mask leaves free; each dealing halves those, so buckets end up below any bound without losing pairs.

Texts: A-Z in lower case; words are runs of other than white space; shingles of `words` words, repeats included. Fewer
words give one shingle, none gives fingerprint zero, which links like any other. A null text is an empty one. Texts of any
length are read whole, one at a time. Null keys are keys like others, and come last; rows that share a key are rows of
their own. Columns beyond key and text are ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from myospark.llm.components import connected
from myospark.llm.spread import fresh, join_dealt, numbered, without
from myospark.session import cut, ensure_workers

SEED = 42
#: Largest bucket that one task compares; and rows of it compared at a time.
LARGE, BLOCK = 2048, 256


def shingles(text: bytes, words: int) -> np.ndarray:
    """The hash of each shingle of `words` words, repeats included."""
    parts = text.lower().split()  # of bytes: A-Z only; space and \x09-\x0D
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    xxh = xxhash.xxh64_intdigest
    return np.array([xxh(joined[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half the hashes, as an unsigned integer; 0 of none."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprint(text: bytes, words: int) -> int:
    """The SimHash as an unsigned integer."""
    return majority(shingles(text, words))


def fingerprints(docs: DataFrame, text: str = "text", words: int = 5) -> DataFrame:
    """docs with `fingerprint` (64 bits in a long). Narrow: no shuffle."""
    ensure_workers(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(bytes(t), words) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("fingerprint", simhash(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int, among: list[int]) -> list[int]:
    """2^(radius+1) - 1 masks over the bit positions `among`; their vectors are dealt in turn."""
    out = []
    for v in range(1, 1 << (radius + 1)):
        out.append(sum(1 << p for i, p in enumerate(among) if ((1 + i % ((1 << (radius + 1)) - 1)) & v).bit_count() % 2))
    return out


def near_pairs(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs that connect what lies within the radius, at most one for each value: later ones with the tree so far."""
    root, out = np.arange(len(values)), []
    for first in range(0, len(values), BLOCK):
        part = values[first : first + BLOCK]
        a, b = np.nonzero(np.bitwise_count(part[:, None] ^ values[None, :]) <= radius)
        a += first
        new = (b > a) & (root[a] != root[b])
        for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True):
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def dealt(rows: DataFrame, radius: int, free: dict[int, list[int]]) -> tuple[DataFrame, dict[int, tuple[int, list[int]]]]:
    """rows (cell, bucket, fingerprint) dealt by masks over each cell's free positions; the new cells' masks and free positions."""
    tables, entries = {}, []
    for cell, positions in free.items():
        for m in masks(radius, positions):
            number = len(tables)
            tables[number] = (m, [p for p in positions if not m >> p & 1])
            entries.append((cell, number, signed(m)))
    # a map from cell to its masks, as a literal
    of = F.create_map(*[x for c in free for x in (F.lit(c), F.array(*[F.struct(F.lit(n).alias("cell"), F.lit(m).alias("mask")) for cc, n, m in entries if cc == c]))])
    out = rows.select("bucket", "fingerprint", F.explode(of[F.col("cell")]).alias("t")).select(
        F.col("t.cell").alias("cell"), F.xxhash64("bucket", "t.cell", F.col("fingerprint").bitwiseAND(F.col("t.mask"))).alias("bucket"), "fingerprint"
    )
    return out, tables


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): for each pair of distinct `fingerprint`s within the radius, a path of such pairs.

    Within a bucket only links that join what is not joined yet are returned, fewer than its fingerprints.
    """
    spark, free, found = prints.sparkSession, {0: list(range(64))}, None
    rows = prints.select(F.lit(0).alias("cell"), F.lit(0).cast("long").alias("bucket"), "fingerprint")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = [], []
            for group in b.column(0).to_pylist():
                values = np.array(group, np.int64)
                for i, j in near_pairs(values.view(np.uint64), radius):
                    a.append(group[i])
                    c.append(group[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    while free:
        spread, tables = dealt(rows, radius, free)
        sizes = spread.groupBy("cell", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = cut(spread.join(sizes, ["cell", "bucket"]))
        small = sized.where(F.col("n") <= LARGE).groupBy("cell", "bucket").agg(F.collect_list("fingerprint").alias("g")).select("g")
        new = small.mapInArrow(compare, "a long, b long")
        found = new if found is None else found.union(new)
        rows = sized.where(F.col("n") > LARGE).drop("n")
        cells = [r["cell"] for r in rows.select("cell").distinct().collect()]  # at most the number of tables
        free = {c: tables[c][1] for c in cells if len(tables[c][1]) > radius}
        stuck = [c for c in cells if c not in free]
        if stuck:  # so few free bits that all in a bucket are within the radius: link them to its least
            full = rows.where(F.col("cell").isin(stuck))
            least = full.groupBy("cell", "bucket").agg(F.min("fingerprint").alias("a"))
            found = found.union(full.join(least, ["cell", "bucket"]).where("a <> fingerprint").select("a", F.col("fingerprint").alias("b")))
    return found.distinct()


def judged(rows: DataFrame, radius: int) -> DataFrame:
    """rows (key, row, fingerprint) with `first`: the least (key, row) that links of at most `radius` bits lead to."""
    place = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    groups = rows.groupBy("fingerprint").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n"))
    roots = connected(links(groups.select("fingerprint"), radius)).withColumnRenamed("vertex", "fingerprint")
    rooted = groups.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("members"))
    classes = join_dealt(rooted.select("root", "fingerprint", "n"), least, ["root"], "members", F.col("fingerprint"))
    return join_dealt(rows, classes.select("fingerprint", "n", "first"), ["fingerprint"], "n", F.col("row")).select("key", "row", "fingerprint", "first")


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 5, radius: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id): component_id is the least key that links of at most `radius` bits lead to."""
    prints = fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), words=words)
    rows = cut(prints.select("key", F.monotonically_increasing_id().alias("row"), "fingerprint"))
    return judged(rows, radius).select(F.col("key").alias(key), "fingerprint", F.col("first.key").alias("component_id"))


def hexadecimal(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def keep_one(docs: DataFrame, text: str = "text", words: int = 5, radius: int = 3, key: str = "doc_id") -> DataFrame:
    """docs without near copies: of each group the row of the least key stays, and one row of those that share it."""
    row = fresh(docs, "row")
    rows = numbered(docs, row)
    prints = fingerprints(rows.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col(text).alias("text")), words=words)
    found = judged(cut(prints.select("key", "row", "fingerprint")), radius)
    return without(rows, found.where(F.col("row") != F.col("first.row")).select(F.col("row").alias(row)), row).select(*docs.columns)


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id, over shingles of three words at radius 3."""
    return near_duplicates(docs, words=3, radius=3).select("doc_id", hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")
