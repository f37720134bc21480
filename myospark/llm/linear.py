"""Linear models over sparse binary features of texts: which features, which weights, which probabilities.

Features are named by strings. Counting them over a labelled sample runs on Spark; what is fitted on the driver is
bounded: at most SAMPLE rows with at most FEATURES chosen features.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from myospark.session import cut, give_back

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000
#: Chosen features, at most; the least log-likelihood ratio of a chosen one; documents that must have it.
FEATURES, LEAST_G2, LEAST_DOCS = 4096, 24.0, 3
#: Tokens whose features a worker remembers; features that a task counts before it sends their counts.
REMEMBERED, COUNTED = 200_000, 200_000

Tokens = Callable[[str], list[str]]
Whole = Callable[[str, list[str]], list[str]]


def bounded_sample(ids: DataFrame, key: str, rows: int = SAMPLE) -> DataFrame:
    """At most `rows` rows of ids, by hash of the key: the same ones each time."""
    return ids.orderBy(F.xxhash64(key), key).limit(rows)


def sampled_texts(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """ids (bounded, distinct keys) with their texts; of several rows with one key, the least text."""
    few = F.broadcast(ids.withColumnRenamed(key, "_key"))
    found = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).join(few, F.col("_doc") == F.col("_key"))
    rest = [c for c in ids.columns if c != key]
    return cut(found.groupBy(F.col("_key").alias(key), *rest).agg(F.min("_text").alias("text")))


class Known(dict):
    """Token -> what `of` makes of it. When full, it forgets what wasn't asked for since it was last full."""

    def __init__(self, of: Callable[[str], object], most: int = REMEMBERED):
        super().__init__()
        self.of, self.most, self.old = of, most, {}

    def __missing__(self, token: str) -> object:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(token)
        self[token] = out = self.of(token) if out is None else out
        return out


def chosen(sample: DataFrame, categories: list[str], tokens: Tokens, whole: Whole, most: int = FEATURES) -> list[str]:
    """The features that tell a category's rows from others best, by log-likelihood ratio, over sample (text, *categories)."""
    n_of = {c: f"_n_{i}" for i, c in enumerate(categories)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        known, total, each = Known(tokens, COUNTED // 2), Counter(), [Counter() for _ in categories]

        def sent() -> Iterator[pa.RecordBatch]:
            names = list(total)
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([total[f] for f in part], pa.int64()), *(pa.array([c[f] for f in part], pa.int64()) for c in each)], ["feature", "_n", *n_of.values()])
            for c in (total, *each):
                c.clear()

        for b in batches:
            for text, *marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = (text or "").split()
                has = set(chain.from_iterable(map(known.__getitem__, set(words)))) | set(whole(text or "", words))
                total.update(has)
                for mark, c in zip(marks, each, strict=True):
                    if mark:
                        c.update(has)
                if len(total) >= COUNTED:
                    yield from sent()
        yield from sent()

    counts = sample.select("text", *categories).mapInArrow(count, ", ".join(["feature string, _n long", *(f"{n} long" for n in n_of.values())]))
    counts = counts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ["_n", *n_of.values()])).where(F.col("_n") >= LEAST_DOCS)
    totals = sample.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(c) > 0).alias(n) for c, n in n_of.items())).first()
    best = F.greatest(F.lit(0.0), *(ratio(F.col(n), F.col("_n"), totals[n], totals["_n"]) for n in n_of.values()))
    top = counts.withColumn("g2", best).where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "feature").limit(most)
    return sorted(r["feature"] for r in top.select("feature").collect())


def ratio(a: Column, n: Column, marked: int, total: int) -> Column:
    """G squared of the table: a of n rows with the feature are marked; `marked` of `total` rows are."""
    parts = [(a, n * (marked / max(total, 1))), (n - a, n * (1 - marked / max(total, 1))), (marked - a, (total - n) * (marked / max(total, 1))), (total - marked - n + a, (total - n) * (1 - marked / max(total, 1)))]
    return 2 * sum((F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0) for o, e in parts), F.lit(0.0))


class Vectors:
    """Texts as sorted arrays of the numbers of their features."""

    def __init__(self, features: list[str], tokens: Tokens, whole: Whole):
        self.number = number = {f: i for i, f in enumerate(features)}
        self.whole = whole
        self.known = Known(lambda token: tuple(number[f] for f in tokens(token) if f in number))

    def of(self, text: str | None) -> list[int]:
        words = (text or "").split()
        has = set(chain.from_iterable(map(self.known.__getitem__, set(words))))
        has.update(self.number[f] for f in self.whole(text or "", words) if f in self.number)
        return sorted(has)


def sample_vectors(sample: DataFrame, columns: list[str], features: list[str], tokens: Tokens, whole: Whole) -> list:
    """Rows (*columns, has) of a bounded sample, on the driver."""

    @F.pandas_udf("array<int>")
    def has(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = Vectors(features, tokens, whole)
        for texts in it:
            yield pd.Series([vectors.of(t) for t in texts])

    return sample.select(*columns, has("text").alias("has")).collect()


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(has: list[list[int]], dense: np.ndarray, y: np.ndarray, m: int, ridge: float = 0.3, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps: weights of m binary features, of dense columns, and bias."""
    n = len(y)
    base = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    if n == 0 or y.min() == y.max():
        return np.zeros(m), np.zeros(dense.shape[1]), base
    rows = np.repeat(np.arange(n), [len(h) for h in has])
    cols = np.fromiter(chain.from_iterable(has), np.int64, len(rows))
    k = m + dense.shape[1] + 1

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, w[cols], n) + dense @ w[m:-1] + w[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(cols, r[rows], m), dense.T @ r, [r.sum()]])

    v = np.ones(k)
    for _ in range(12):
        v = back(times(v / np.linalg.norm(v)))
    step = 1.0 / (0.25 * np.linalg.norm(v) * 1.05 + ridge)
    w = np.zeros(k)
    w[-1] = base
    ahead, t = w.copy(), 1.0
    keep = np.ones(k)
    keep[-1] = 0.0
    for _ in range(steps):
        new = ahead - step * (back(sigmoid(times(ahead)) - y) + ridge * keep * ahead)
        t, was = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (was - 1) / t * (new - w), new
    return w[:m], w[m:-1], float(w[-1])


def margins(model: tuple[np.ndarray, np.ndarray, float], has: list[list[int]], dense: np.ndarray) -> np.ndarray:
    weights, more, bias = model
    return np.array([weights[h].sum() if len(h) else 0.0 for h in has]) + dense @ more + bias


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift that make margins probabilities (Platt, 1999), by Newton steps."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t, a, b = np.where(y > 0, up, down), 1.0, 0.0

    def loss(a: float, b: float) -> float:
        x = a * z + b
        return float((np.logaddexp(0, x) - t * x).sum() + 5e-4 * (a - 1) ** 2)

    for _ in range(steps):
        p = sigmoid(a * z + b)
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-9]])
        d, before = np.linalg.solve(h, g), loss(a, b)
        while loss(a - d[0], b - d[1]) > before and np.abs(d).max() > 1e-9:
            d /= 2
        a, b = a - d[0], b - d[1]
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)
