"""Toxicity by a classifier chain: linear models for the categories of the labels table in order, quality then toxic,
each fed the probabilities of the earlier ones.

Features are a document's distinct words and word beginnings, hashed into 2^18 places; for each category the KEPT places that tell it
best apart (chi-squared on the sample) enter a logistic regression with L2, beside the probabilities that the
earlier models gave. While training, those come from models that did not see the document, nor chose their
features by it (out of fold), so a later model learns how far to trust an earlier one on new text.

Training reads a bounded sample, SAMPLE labelled documents in the order of a hash of their id; scoring reads
every document whole. The model, at most 2^18 weights a category, is all that is broadcast.

Defined cases: null or empty text has no features and is scored by the models' constants; a null label is no
label of that category; labels without a document and documents without labels take no part in training; of
several labels for one doc_id the largest counts; repeated rows are scored alike; without any labelled row of a
category its probability is 0; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_id_of, doc_key, table

PLACES, KEPT, SAMPLE, FOLDS = 1 << 18, 300, 6000, 3
#: Letters of the word beginnings that are features beside whole words, for words not seen in training.
STEMS = (4, 5)
CHAIN = ("quality", "toxic")


def places(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+")
    words = F.array_distinct(F.filter(words, lambda w: w != ""))
    stems = F.flatten(F.transform(words, lambda w: F.array(w, *[F.concat(F.lit("^"), F.left(w, F.lit(k))) for k in STEMS])))
    return F.array_distinct(F.transform(stems, lambda w: F.pmod(F.xxhash64(w), F.lit(PLACES)).cast("int")))


class Texts:
    """Documents as lists of places, one after another."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.n = flat, len(lengths)
        self.doc = np.repeat(np.arange(self.n), lengths)

    def dense(self, kept: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(kept, self.flat), max(len(kept) - 1, 0))
        hit = kept[at] == self.flat if len(kept) else np.zeros(len(self.flat), bool)
        x = np.zeros((self.n, len(kept)))
        x[self.doc[hit], at[hit]] = 1
        return x

    def telling(self, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The KEPT places with the largest chi-squared against y among the documents `rows`."""
        n, pos, seen = rows.sum(), y[rows].sum(), rows[self.doc]
        all_, with_ = np.bincount(self.flat[seen], minlength=PLACES), np.bincount(self.flat[seen & (y[self.doc] > 0)], minlength=PLACES)
        expected = all_ * pos / max(n, 1)
        spread = expected * (1 - pos / max(n, 1)) * (1 - all_ / max(n, 1))
        chi = np.where((all_ >= 5) & (spread > 0), (with_ - expected) ** 2 / np.maximum(spread, 1e-12), 0)
        best = np.argsort(-chi, kind="stable")[:KEPT]
        return np.sort(best[chi[best] > 0])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, turns: int = 8) -> np.ndarray:
    """Weights, the constant last, by Newton steps; the constant is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    shrink[-1] = 1e-3
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + shrink * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Link:
    """A model of the chain: weights of kept places, then of the earlier probabilities, then the constant; None: never labelled."""

    kept: np.ndarray
    weights: np.ndarray | None

    def probability(self, texts: Texts, earlier: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(texts.n)
        k = len(self.kept)
        at = np.minimum(np.searchsorted(self.kept, texts.flat), max(k - 1, 0))
        per = np.where(self.kept[at] == texts.flat, self.weights[:k][at], 0) if k else np.zeros(len(texts.flat))
        return 1 / (1 + np.exp(-np.clip(np.bincount(texts.doc, per, texts.n) + earlier @ self.weights[k:-1] + self.weights[-1], -30, 30)))


def fit_chain(texts: Texts, labels: np.ndarray) -> list[Link]:
    """labels: one column a category, nan where unknown."""
    fold = np.arange(texts.n) % FOLDS
    earlier, chain = np.zeros((texts.n, 0)), []

    def fitted(rows: np.ndarray, y: np.ndarray) -> Link:
        rows = rows & ~np.isnan(y)
        if not rows.any() or not (y[rows] > 0).any():
            return Link(np.zeros(0, int), None)
        kept = texts.telling(np.nan_to_num(y), rows)
        return Link(kept, logistic(np.hstack([texts.dense(kept)[rows], earlier[rows]]), y[rows]))

    for y in labels.T:
        held_out = np.zeros(texts.n)
        for f in range(FOLDS):
            held_out[fold == f] = fitted(fold != f, y).probability(texts, earlier)[fold == f]
        chain.append(fitted(np.ones(texts.n, bool), y))
        earlier = np.hstack([earlier, held_out[:, None]])
    return chain


def chain_scores(chain: list[Link], texts: Texts) -> np.ndarray:
    """Probabilities, one column a category."""
    earlier = np.zeros((texts.n, 0))
    for link in chain:
        earlier = np.hstack([earlier, link.probability(texts, earlier)[:, None]])
    return earlier


def _texts(column: pa.ListArray) -> Texts:
    offsets = np.asarray(column.offsets)
    return Texts(np.asarray(column.values)[offsets[0] : offsets[-1]], np.diff(offsets))


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> list[Link]:
    """labels(_id, one column a category); the sample's places and labels come to the driver, SAMPLE rows at most."""
    sample = labels.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    texts = docs.select(doc_key().alias("_id"), F.col("text"))
    rows = texts.join(F.broadcast(sample), "_id").select("_id", places(F.col("text")).alias("places"), *[F.col(c).cast("double") for c in categories])
    got = rows.dropDuplicates(["_id"]).orderBy("_id").toArrow().combine_chunks()
    if not got.num_rows:
        return [Link(np.zeros(0, int), None) for _ in categories]
    column = got.column("places")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    y = np.column_stack([got.column(c).to_numpy(zero_copy_only=False).astype(float) for c in categories])
    return fit_chain(_texts(column), y)


def scored(docs: DataFrame, chain: list[Link], categories: Sequence[str]) -> DataFrame:
    """(_id, a probability for each category) of each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain_scores(model.value, _texts(batch.column("places")))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(c) for c in p.T)], ["_id", *categories])

    rows = docs.select(doc_key().alias("_id"), places(F.col("text")).alias("places"))
    return rows.mapInArrow(run, "_id long, " + ", ".join(f"`{c}` double" for c in categories))


def verdicts(labels: DataFrame) -> DataFrame:
    """(_id, CHAIN): the labels table, one row a document; a null label is none of that category."""
    said = [F.max(F.col(c).cast("int")).alias(c) for c in CHAIN]
    known = F.coalesce(*[F.col(c).cast("int") for c in CHAIN]).isNotNull()
    return labels.where(known).groupBy(doc_key().alias("_id")).agg(*said)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(docs, verdicts(table(spark, sf_dir, "labels")), CHAIN)
    out = scored(docs, chain, CHAIN)
    return out.select(doc_id_of(F.col("_id")).alias("doc_id"), *[F.col(c).alias(f"p_{c}") for c in CHAIN], (F.col("toxic") >= 0.5).alias("toxic"))
