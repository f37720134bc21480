"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken, 2003).

Rolling hashes of all k-grams of the normalised text; of each window of w hashes the least is kept, the rightmost of
equals, with its position. Two texts that share k + w - 1 normalised characters share a kept hash.

Normalised: A-Z in lower case, white space dropped; positions are code points of the whole text. Texts of fewer than k
such characters have one hash, of all of them, and texts without any have none. Texts of any length are fingerprinted whole.
A null text is an empty one; a null doc_id sorts first. Rows with equal doc_id follow each other by text, and in no fixed
order where there are more than a range of rows holds. Other columns are ignored, whatever their names; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from myospark.llm.spread import fresh
from myospark.llm.words import mix, powers
from myospark.session import ensure_workers

K, W = 16, 85
#: k-grams looked at together, at most; also the bound below which a position fits beside a hash in 64 bits.
CHUNK = 1 << 20
LOW = np.uint64((1 << 24) - 1)
#: Rows of one doc_id range, and ranges at most (their edges go to every task).
RANGE_ROWS, MOST_RANGES = 1000, 65536

def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def normalise(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept characters and where they stood."""
    at = np.flatnonzero((points > 32) & (points != 0xA0) & (points != 0x3000))
    kept = points[at].astype(np.uint64)
    return np.where((kept >= 65) & (kept <= 90), kept + np.uint64(32), kept), at


def rolling(chars: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams: differences of running sums, shifted to the same power."""
    up, down = powers(len(chars))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars + np.uint64(1)) * up)])
    return mix((sums[k:] - sums[:-k]) * down[: len(chars) - k + 1])


def least_right(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash of each window, the rightmost of equals, each once, ascending."""
    w = min(w, len(hashes))
    found = []
    for first in range(0, len(hashes) - w + 1, CHUNK):
        part = hashes[first : first + CHUNK + w - 1]
        low = (part & ~LOW) | (LOW - np.arange(len(part), dtype=np.uint64))  # of equal hashes, the later is less
        span = 1
        while 2 * span <= w:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        at = (LOW - (low & LOW)).astype(np.int64)
        found.append(first + at[np.concatenate([[True], at[1:] != at[:-1]])])
    at = np.concatenate(found)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def winnow(points: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes (64 bits; windows compare their leading 40) and their positions in the text."""
    chars, at = normalise(points)
    if not len(chars):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = rolling(chars, min(k, len(chars)))
    kept = least_right(hashes, w)
    return hashes[kept], at[kept]


def digest(kept: tuple[np.ndarray, np.ndarray]) -> str:
    """16 hexadecimal digits of hash and 8 of position for each kept k-gram."""
    out = np.empty(len(kept[0]), [("hash", ">u8"), ("at", ">u4")])
    out["hash"], out["at"] = kept
    return out.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the sets of hashes; two empty sets are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """docs with `hashes` and `positions` of the kept k-grams. Narrow: no shuffle."""
    ensure_workers(docs.sparkSession)
    kind = "struct<hashes:array<long>,positions:array<long>>"

    @F.pandas_udf(kind)
    def kept(texts):
        import pandas as pd

        rows = [winnow(code_points(t or ""), k, w) for t in texts]
        return pd.DataFrame({"hashes": [r[0].view(np.int64) for r in rows], "positions": [r[1] for r in rows]})

    found = fresh(docs, "_kept")
    return docs.withColumn(found, kept(text)).select(*[c for c in docs.columns if c not in ("hashes", "positions")], f"{found}.*")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guard, key, doc_id, text) in sorted partitions: inside a bucket, each row's successor by doc_id follows it.

    Buckets are doc_id ranges. A bucket's first row goes to the bucket before it too, as its guard; the first row of
    all is the guard of the last bucket. Texts are shuffled once.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, min(MOST_RANGES, -(-docs.count() // RANGE_ROWS)))
    found = rows.agg(F.percentile_approx("key", [i / n for i in range(n)], 10 * n).alias("x")).first()["x"] or [0]
    edges, times = np.unique(np.array(found, np.int64), return_counts=True)  # each is a row's key
    times = (times + 1) // 2  # of the ranges that one key fills, every second is used: none is left empty
    first, total = np.cumsum(times) - times, int(times.sum())

    @F.pandas_udf("array<struct<bucket:int,guard:boolean,tie:int>>")
    def buckets(keys, numbers):
        import pandas as pd

        key = keys.to_numpy()
        at = np.maximum(np.searchsorted(edges, key, "right") - 1, 0)
        hot, edge = times[at] > 1, edges[at] == key
        # the rows of a key that fills several ranges are dealt to the first ones of these; the last takes what follows
        tie = np.where(hot & edge, (mix(numbers.to_numpy().astype(np.uint64) + np.uint64(1)) >> np.uint64(33)).astype(np.int64), 0)
        own = first[at] + np.where(hot, np.where(edge, tie * times[at] >> 31, times[at] - 1), 0)
        order = np.lexsort([tie, key, own])
        least = np.zeros(len(key), bool)
        least[order[np.append(True, own[order][1:] != own[order][:-1])]] = True
        guard = edge & np.where(hot, least, True) | (own == 0) & least
        return pd.Series([[{"bucket": b, "guard": False, "tie": t}] + ([{"bucket": (b - 1) % total, "guard": True, "tie": t}] if g else []) for b, t, g in zip(own.tolist(), tie.tolist(), guard.tolist(), strict=True)])

    dealt = rows.select(F.explode(buckets("key", F.monotonically_increasing_id())).alias("b"), "key", "doc_id", "text")
    return dealt.select("b.bucket", "b.guard", "key", "doc_id", "text", "b.tie").repartition("bucket").sortWithinPartitions("bucket", "guard", "key", "tie", "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_kept long"


def compare_edits(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last quarter replaced by the start of the next text."""
    ensure_workers(docs.sparkSession)

    def pair(row: tuple, follower: tuple) -> tuple:
        (_, doc_id, text, kept), (_, _, after, kept_after) = row, follower
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        kept_edited = winnow(code_points(edited), k, w)
        return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(kept), digest(kept_edited), likeness(kept[0], kept_edited[0]), likeness(kept[0], kept_after[0]), len(kept[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, closed = None, None
        for b in batches:
            out = []
            for bucket, guard, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if bucket == closed:  # a later row with the guard's doc_id
                    continue
                row = (bucket, doc_id, text, winnow(code_points(text), k, w))
                if last is not None:
                    if last[0] != bucket:
                        raise RuntimeError(f"range {last[0]} has no row after it")
                    out.append(pair(last, row))
                last, closed = (None, bucket) if guard else (row, None)
            types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
            names = [c.split()[0] for c in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
        if last is not None:
            raise RuntimeError(f"range {last[0]} has no row after it")

    return with_next(docs).mapInArrow(run, RESULT)
