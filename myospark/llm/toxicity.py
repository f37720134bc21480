"""Toxicity by classifier chains (Read et al., 2009).

Categories are predicted one after another: the linear model of each sees the text's features and the earlier
categories' log-odds, which in training are out-of-fold predictions, so that later models learn from errors they will meet. Log-odds say
what probabilities say, on the scale on which a linear model adds up evidence; probabilities near 0 and 1 would hardly differ there.

Features are the words of the whole text, each once, and their leading characters. Models are fitted on at most SAMPLE
labelled documents, chosen by hash of the id; every document is scored in one narrow pass.

A null text is an empty one; an empty text gets the base rate. Texts of any length are read whole. Repeated rows are scored
alike; of labelled rows that share an id the least text is learned from. Ties in the choice of features are broken by name.
With no labels every probability is 0.5 and nothing is marked. An empty table gives an empty table. Columns with the names of the
results are replaced; others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from myospark.llm import linear
from myospark.llm.spread import fresh
from myospark.session import ensure_workers, give_back

FOLDS = 5
PREFIXES = (4, 5, 6, 7, 8)


def word_features(token: str) -> list[str]:
    """The word in lower case without what stands around its letters, and its starts."""
    word = token.lower()
    if not word.isalnum():
        word = "".join(c if c.isalnum() else " " for c in word).strip()
    out = []
    for part in word.split() if " " in word else ([word] if word else []):
        out.append(f"w:{part}")
        out.extend(f"{n}:{part[:n]}" for n in PREFIXES if len(part) > n)
    return out


def no_features(_text: str, _words: list[str]) -> list[str]:
    return []


@dataclass
class Chain:
    categories: list[str]
    features: list[str]
    models: list[tuple[np.ndarray, np.ndarray, float]]

    def odds(self, has: list[list[int]]) -> np.ndarray:
        """Log-odds, a column for each category."""
        z = np.zeros((len(has), 0))
        for model in self.models:
            z = np.column_stack([z, np.clip(linear.margins(model, has, z), -20, 20)])
        return z


def fit_chain(has: list[list[int]], marks: np.ndarray, features: list[str], categories: list[str]) -> Chain:
    """marks: rows by categories, 0 or 1."""
    n, m = len(has), len(features)
    fold, seen, models = np.arange(n) % FOLDS, np.zeros((n, 0)), []
    for j in range(len(categories)):
        y, out = marks[:, j].astype(float), np.zeros(n)
        for f in range(FOLDS):
            own, other = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(own):
                model = linear.fit([has[i] for i in other], seen[other], y[other], m)
                out[own] = linear.margins(model, [has[i] for i in own], seen[own])
        models.append(linear.fit(has, seen, y, m))
        seen = np.column_stack([seen, np.clip(out, -20, 20)])
    return Chain(categories, features, models)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", rows: int = linear.SAMPLE) -> Chain:
    """labels: key and a 0/1 column for each category; of several rows with one key, a mark in any counts."""
    ensure_workers(docs.sparkSession)
    marks = labels.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)).alias(c) for c in categories))
    sample = linear.sampled_texts(docs, linear.bounded_sample(marks, key, rows), key, text)
    features = linear.chosen(sample, categories, word_features, no_features)
    found = sorted(linear.sample_vectors(sample, [key, *categories], features, word_features, no_features), key=lambda r: r[key])
    return fit_chain([r["has"] for r in found], np.array([[r[c] for c in categories] for r in found]).reshape(len(found), len(categories)), features, categories)


def score(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with p_<category> for each category and is_toxic: the first category's probability is above the threshold."""
    ensure_workers(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def probabilities(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()
        vectors = linear.Vectors(chain.features, word_features, no_features)
        for texts in it:
            yield pd.DataFrame(linear.sigmoid(chain.odds([vectors.of(t) for t in texts])), columns=names)

    kept, found = [c for c in docs.columns if c not in (*names, "is_toxic")], fresh(docs, "found")
    return docs.select(*kept, probabilities(text).alias(found)).select(*kept, f"{found}.*").withColumn("is_toxic", F.col(names[0]) > threshold)


def label_categories(labels: DataFrame) -> DataFrame:
    """The categories that the labels tell apart: toxic, and in which company: in junk or in otherwise good prose."""
    toxic, good = F.col("toxic") > 0, F.coalesce(F.col("quality"), F.lit(1)) > 0
    return labels.select("doc_id", toxic.cast("int").alias("toxic"), (toxic & ~good).cast("int").alias("toxic_junk"), (toxic & good).cast("int").alias("toxic_prose"))


CATEGORIES = ["toxic", "toxic_junk", "toxic_prose"]


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_toxic, p_toxic_junk, p_toxic_prose, is_toxic, for every document.

    `labels` holds one mark of toxicity. The later categories tell in which company it was found; where quality is known they
    follow from the first.
    """
    return score(docs.select("doc_id", "text"), train(docs, label_categories(labels), CATEGORIES)).drop("text")
