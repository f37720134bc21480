"""Quality classification by co-training (Blum and Mitchell, 1998).

Two views of a document that share nothing: its text (words, marks around them, repetition, layout), and metadata of the page
it is from: the METADATA columns, each by itself and in pairs (text as it is, of addresses the host and the parts of the
path, numbers by order of magnitude). A linear classifier for each is fitted on labelled documents. In each round both views
score all unlabelled documents; each labels those that it is surest of, in the share of the classes, for the other. Then each
view's margins are calibrated on labelled documents held out from training, and the calibrated log-odds are weighed into one
score for every document.

Labelled documents used in fitting are at most SAMPLE, chosen by hash of the id; a view labels at most SHARE of that number in a
round, of all unlabelled documents those with the greatest and least margins (ties by hash of the row). A null text is an empty
one, read whole at any length; null metadata is a value of its own, and so is a column that isn't there. Repeated rows are scored
alike; of labelled rows that share an id one is learned from. With no labels every score is 0.5 and everything is kept. An empty
table gives an empty table. Columns with the names of the results are replaced; others may have any names.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from myospark.llm import linear
from myospark.llm.spread import fresh, small, written
from myospark.llm.words import mix
from myospark.session import cut, ensure_workers

ROUNDS, SHARE, SURE = 4, 0.1, 0.9
#: Of the labelled rows, one in so many is held out to calibrate.
HELD_OUT = 4
#: Nothing here follows from the text: its length, say, is the content view's.
METADATA = ("source", "lang")


def content_tokens(token: str) -> list[str]:
    """The word in lower case, the marks around it, and whether it shouts."""
    word = token.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    out = [f"w:{word.lower()}"] if word else ["w:"]
    if len(word) < len(token):
        at = token.find(word) if word else len(token)
        out.append(f"m:{token[:at][:4]}_{token[at + len(word):][:4]}")
    if len(word) > 1 and word.isupper():
        out.append("upper")
    return out


def step(x: float, n: int = 20) -> int:
    return int(x * n)


def content_whole(text: str, words: list[str]) -> list[str]:
    """How much the text repeats itself, and its layout: length, lines and the share of kinds of characters, in steps."""
    n, size = len(words), len(text)
    lines = text.count("\n") + 1
    marks = sum(map(text.count, "#$%&*|!"))
    laid = [f"chars:{size.bit_length()}", f"lines:{lines.bit_length()}", f"line:{(size // lines).bit_length()}", f"word:{step(text.count(' ') / (size + 1), 50)}", f"marks:{step(marks / (size + 1), 40)}", f"stops:{step(text.count('.') / (size + 1), 200)}"]
    if n < 2:
        return [f"short:{n}", *laid]
    again = sum(map(operator.eq, words, words[1:])) / (n - 1)
    upper = sum(map(str.isupper, words)) / n
    return [f"again:{step(again)}", f"upper:{step(upper)}", f"distinct:{n.bit_length()}:{step(len(set(words)) / n, 10)}", *laid] + ["repeats"] * (again > 0.2)


def page_features(values: tuple[str | None, ...]) -> list[str]:
    """What each column says, and what each two of them say together."""
    out = []
    for i, value in enumerate(values):
        if value is None:
            out.append([f"{i}:"])
        elif re.fullmatch(r"-?[0-9]+", value):
            out.append([f"{i}#{int(value).bit_length()}"])
        elif "://" in value:
            host, _, path = value.split("://", 1)[1].partition("/")
            out.append([f"{i}@{host}", *(f"{i}/{p}" for p in re.split(r"[^A-Za-z0-9]+", path) if p)])
        else:
            out.append([f"{i}:{value}"])
    return [f for x in out for f in x] + [f"{x[0]} {y[0]}" for x, y in combinations(out, 2)]


@dataclass
class View:
    features: list[str]
    model: tuple[np.ndarray, np.ndarray, float]
    scale: tuple[float, float]
    weight: float

    def odds(self, has: list[list[int]]) -> np.ndarray:
        z = linear.margins(self.model, has, np.zeros((len(has), 0)))
        return np.clip(self.scale[0] * z + self.scale[1], -20, 20)


def fit_view(rows: list[list[int]], marks: np.ndarray, features: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    return linear.fit(rows, np.zeros((len(rows), 0)), marks, len(features))


def calibrated(model: tuple, rows: list[list[int]], marks: np.ndarray, features: list[str]) -> View:
    """A view, calibrated and weighed on labelled rows that it hasn't seen."""
    z = linear.margins(model, rows, np.zeros((len(rows), 0)))
    view = View(features, model, linear.platt(z, marks), 1.0)
    p = np.clip(linear.sigmoid(view.odds(rows)), 1e-6, 1 - 1e-6)
    base = np.clip(marks.mean() if len(marks) else 0.5, 1e-6, 1 - 1e-6)
    lost = lambda p: float((marks * np.log(p) + (1 - marks) * np.log(1 - p)).sum())
    gain = 1 - lost(p) / min(-1e-9, lost(base)) if len(marks) else 0.0
    view.weight = float(np.clip(gain, 0.01, 1.0))  # the share of the base rate's loss that the view takes away
    return view


class Pool:
    """The unlabelled documents' features: a table (row, content, page) that each round reads once."""

    def __init__(self, table: DataFrame):
        self.table, self.taken = table, [np.zeros(0, np.int64)] * 2

    def surest(self, models: list[tuple], rate: float, most: int) -> list[tuple[list[list[int]], np.ndarray]]:
        """For each view the rows that it is surest of and that the other view hasn't got, as that view's features, and their marks.

        Each task sends its own best of both views and both classes, which are written; the best of all are among them.
        """
        taken = [np.sort(self.taken[1 - v]) for v in (0, 1)]
        kinds = [(v, up, max(1, round(most * (rate if up else 1 - rate)))) for v in (0, 1) for up in (True, False)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple]] = [[] for _ in kinds]
            for b in batches:
                row = b.column(0).to_numpy()
                tie = (mix(row.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
                for v in (0, 1):
                    lists, (weights, _, bias) = b.column(1 + v), models[v]
                    n = lists.value_lengths().to_numpy()
                    z = np.full(len(row), bias)
                    if n.any():
                        z[n > 0] += np.add.reduceat(weights[lists.flatten().to_numpy()], (np.cumsum(n) - n)[n > 0])
                    p, found = linear.sigmoid(z), np.isin(row, taken[v])
                    for own, (view, up, k) in zip(best, kinds, strict=True):
                        if view == v:
                            sure = np.flatnonzero(~found & (p >= SURE if up else p <= 1 - SURE))
                            own.append((row[sure], z[sure], tie[sure], b.column(2 - v).take(pa.array(sure))))
                            if sum(len(x[0]) for x in own) > 4 * k:
                                own[:] = [top(own, up, k)]
            for own, (view, up, k) in zip(best, kinds, strict=True):
                if own:
                    row, z, tie, features = top(own, up, k)
                    same = lambda x, kind: pa.array([x] * len(row), kind)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(view, pa.int32()), same(up, pa.bool_()), pa.array(row), pa.array(z), pa.array(tie), features], ["view", "up", "row", "z", "tie", "has"])

        def top(best: list, up: bool, k: int) -> tuple:
            row, z, tie = (np.concatenate([x[i] for x in best]) for i in range(3))
            order = np.lexsort([tie, -z if up else z])[:k]
            return row[order], z[order], tie[order], pa.concat_arrays([x[3] for x in best]).take(pa.array(order))

        sent = cut(self.table.select("row", "content", "page").mapInArrow(run, "view int, up boolean, row long, z double, tie long, has array<int>"))
        out: list[tuple[list, np.ndarray]] = [([], np.zeros(0))] * 2
        for view, up, k in kinds:
            few = sent.where((F.col("view") == view) & (F.col("up") == up)).orderBy(F.desc("z") if up else F.asc("z"), "tie").limit(k).collect()
            out[view] = out[view][0] + [r["has"] for r in few], np.append(out[view][1], [float(up)] * len(few))
            self.taken[1 - view] = np.append(self.taken[1 - view], np.array([r["row"] for r in few], np.int64))
        return out


def co_train(labelled: list[list[list[int]]], y: np.ndarray, pool: Pool, features: list[list[str]], most: int, rounds: int = ROUNDS) -> list[View]:
    """labelled: for each of two views, the rows' feature numbers. most: rows that a view labels in a round."""
    n = len(y)
    held, taught = np.arange(n) % HELD_OUT == 0, np.arange(n) % HELD_OUT != 0
    rate = float(y.mean()) if n else 0.5
    own = [[labelled[v][i] for i in np.flatnonzero(taught)] for v in (0, 1)]
    marks = [y[taught].astype(float)] * 2
    models = [fit_view(own[v], marks[v], features[v]) for v in (0, 1)]
    for _ in range(rounds if 0 < rate < 1 else 0):
        new = pool.surest(models, rate, most)
        for v, to in ((0, 1), (1, 0)):
            own[to] = own[to] + new[v][0]
            marks[to] = np.concatenate([marks[to], new[v][1]])
        models = [fit_view(own[v], marks[v], features[v]) for v in (0, 1)]
    return [calibrated(models[v], [labelled[v][i] for i in np.flatnonzero(held)], y[held].astype(float), features[v]) for v in (0, 1)]


def metadata_of(docs: DataFrame, names: tuple[str, ...]) -> Column:
    return F.array(*(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in names))


def vectors_of(features: list[list[str]]):
    """A function from (text, metadata) to the numbers of both views' features."""
    content = linear.Vectors(features[0], content_tokens, content_whole)
    numbers = {f: i for i, f in enumerate(features[1])}

    def of(text: str | None, values: list[str | None]) -> tuple[list[int], list[int]]:
        return content.of(text), sorted({numbers[f] for f in page_features(tuple(values)) if f in numbers})

    return of


def both_views(features: list[list[str]]):
    """A UDF of (text, metadata)."""

    @F.pandas_udf("content array<int>, page array<int>")
    def both(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        of = vectors_of(features)
        for cols in it:
            yield pd.DataFrame([of(*r) for r in zip(*cols, strict=True)], columns=["content", "page"])

    return both


@dataclass
class Trained:
    """The views, and the features of all documents (row, key, content, page)."""

    views: list[View]
    metadata: tuple[str, ...]
    table: DataFrame


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = linear.SAMPLE, metadata: tuple[str, ...] = METADATA) -> Trained:
    """docs: key, text and metadata. labels: key and 0/1; of several rows with one key, the least mark counts."""
    ensure_workers(docs.sparkSession)
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.col(label).cast("int")).alias("mark"))
    few = linear.bounded_sample(marks, "key", rows)
    given = docs.select(F.col(key).alias("key"), F.struct(F.coalesce("text", F.lit("")).alias("text"), metadata_of(docs, metadata).alias("meta")).alias("row"))
    known = linear.sampled_texts(given, few, "key", "row").select("mark", "text.*").withColumn("low", 1 - F.col("mark"))
    content = linear.chosen(known, ["low"], content_tokens, content_whole)

    @F.pandas_udf("array<string>")
    def paged(values: pd.Series) -> pd.Series:
        return pd.Series([page_features(tuple(v)) for v in values])

    names = known.select(F.explode(F.array_distinct(paged("meta"))).alias("f")).groupBy("f").count().orderBy(F.desc("count"), "f").limit(linear.FEATURES)
    features = [content, sorted(r["f"] for r in names.collect())]
    vectors = given.select(F.monotonically_increasing_id().alias("row"), "key", both_views(features)("row.text", "row.meta").alias("v"))
    table = written(vectors.select("row", "key", "v.*"))
    found = table.join(F.broadcast(few), "key").groupBy("key").agg(F.min(F.struct("mark", "content", "page")).alias("x")).orderBy("key").select("x.*").collect()
    labelled = [[r["content"] for r in found], [r["page"] for r in found]]
    free = written(table.join(small(marks.select("key")), "key", "left_anti").select("row", "content", "page"))
    views = co_train(labelled, np.array([r["mark"] for r in found]), Pool(free), features, max(2, round(SHARE * rows)))
    return Trained(views, metadata, table)


NAMES = ["p_content", "p_page", "score"]


def probabilities(views: list[View], content: list, page: list) -> np.ndarray:
    """Columns NAMES."""
    z, weight = np.column_stack([view.odds(has) for view, has in zip(views, (content, page), strict=True)]), np.array([v.weight for v in views])
    return linear.sigmoid(np.column_stack([z, z @ weight / weight.sum()]))


def score(docs: DataFrame, trained: Trained, threshold: float = 0.5) -> DataFrame:
    """docs with p_content, p_page, score (all of being good) and keep."""
    ensure_workers(docs.sparkSession)
    views = trained.views

    @F.pandas_udf(", ".join(f"{n} double" for n in NAMES))
    def scored(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        of = vectors_of([v.features for v in views])
        for cols in it:
            rows = [of(*r) for r in zip(*cols, strict=True)]
            yield pd.DataFrame(probabilities(views, [r[0] for r in rows], [r[1] for r in rows]), columns=NAMES)

    kept = [c for c in docs.columns if c not in (*NAMES, "keep")]
    found = fresh(docs, "found")
    return docs.select(*kept, scored(F.coalesce("text", F.lit("")), metadata_of(docs, trained.metadata)).alias(found)).select(*kept, f"{found}.*").withColumn("keep", F.col("score") >= threshold)


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_content, p_page, score, keep, for every document; from the features that training has written."""
    trained = train(docs, labels)
    views = trained.views

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = probabilities(views, b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, i]) for i in range(3)), pa.array(p[:, 2] >= threshold)], ["doc_id", *NAMES, "keep"])

    rows = trained.table.select(F.col("key").cast("long").alias("doc_id"), "content", "page")
    return rows.mapInArrow(run, "doc_id long, p_content double, p_page double, score double, keep boolean")
