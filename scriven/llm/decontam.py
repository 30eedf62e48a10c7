"""Benchmark decontamination: a BM25 index of the test items, queried by every passage of every document.

A document's words (letters, digits and marks; lower case) are cut into passages of twice the longest item,
half overlapping, so that any copy of an item lies whole in one of them. Scores are BM25 divided by the
item's score against itself, with each distinct query word once: 1 means that all of the item's words are
there. Items stand in blocks; for each word and block the index keeps the largest score that the word can add
to an item there. A passage visits only the blocks whose sum of such bounds reaches RETRIEVE (block-max
WAND, worked off for many passages at once in arrays) and scores their items exactly.
Each item retrieved is verified on five-word shingles of its question and its answer: the document is contaminated if it
holds at least OVERLAP of the shingles of the two together and at least PART_OVERLAP of each, so a question without its
answer is not. Both overlaps are reported.

The question is the item up to its last "?", else its last line end, else its last sentence end; the answer is
the rest, empty if nothing remains. The index is used in parts of at most PART_WORDS words, one after
another, so what a task is sent is bounded however many items there are; idf and mean length are over all items.

Defined cases: null or empty texts match nothing, items without words are never found; an item of one to
four words is one shingle; rows with one doc_id are one document, which is contaminated if any is; repeated
items are one; items with one item_id are one item, those without are told apart by their text and bear a null
item_id; an empty table on either side gives no row; other columns pass through the stage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_id_of, doc_key, table, written
from .near_dedup import WORDS, _chunks, mixed

K1, B = 1.2, 0.75
RETRIEVE, OVERLAP, PART_OVERLAP = 0.5, 0.8, 0.5
BLOCK_ITEMS, PART_WORDS = 8, 1_000_000


def word_hashes(text: Column) -> Column:
    found = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}\\p{M}]+")
    return F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w))


def with_question_and_answer(items: DataFrame) -> DataFrame:
    text = F.trim(F.coalesce(F.col("text").cast("string"), F.lit("")))
    by = [F.regexp_extract(text, p, 1) for p in ("(?s)^(.*\\?).*\\S", "(?s)^(.*\\S)\\s*\\n.*\\S", "(?s)^(.*[.!])\\s.*\\S")]
    question = F.when(by[0] != "", by[0]).when(by[1] != "", by[1]).when(by[2] != "", by[2]).otherwise(text)
    return items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("_t"), question.alias("question")).select("item_id", "question", F.expr("substring(_t, length(question) + 1)").alias("answer"))


def _grams(words: np.ndarray) -> np.ndarray:
    """Five-word shingles in order; all words as one where there are fewer."""
    words = words.astype(np.uint64)
    n = max(len(words) - WORDS + 1, 1) if len(words) else 0
    h = np.full(n, 7, np.uint64)
    for k in range(min(WORDS, len(words))):
        h = mixed(h ^ words[k : k + n], k + 1)
    return h


@dataclass
class Index:
    """Postings of a part of the items, item by item within blocks; arrays only, sent to the tasks."""

    item_ids: np.ndarray
    span: int
    vocabulary: np.ndarray  # sorted word hashes
    first: np.ndarray  # of each word's postings
    items: np.ndarray  # posting: item
    weights: np.ndarray  # posting: share of the item's own score
    block_first: np.ndarray  # of each word's blocks
    blocks: np.ndarray
    bounds: np.ndarray
    grams: list  # per item: (question shingles, answer shingles)
    public_ids: list | None = None  # per item: its item_id, which may be null; item_ids are numbers of the index

    @classmethod
    def build(cls, rows: list, df: dict[int, int], n_items: int, mean: float) -> Index:
        """rows: (item_id, question words, answer words)"""
        word, item, weight = [], [], []
        for k, (_, q, a) in enumerate(rows):
            all_words, tf = np.unique(np.array([*q, *a], np.int64).view(np.uint64), return_counts=True)
            idf = np.array([math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) for w in all_words.view(np.int64).tolist()])
            score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / mean))
            word.append(all_words)
            item.append(np.full(len(all_words), k))
            weight.append(score / score.sum())
        word, item, weight = np.concatenate(word), np.concatenate(item), np.concatenate(weight)
        order = np.lexsort((item, word))
        word, item, weight = word[order], item[order], weight[order]
        vocabulary, first = np.unique(word, return_index=True)
        key = np.stack([np.searchsorted(vocabulary, word), item // BLOCK_ITEMS])
        new = np.ones(len(word), bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        at = np.flatnonzero(new)
        block_first = np.searchsorted(key[0][at], np.arange(len(vocabulary) + 1))
        grams = [(_grams(np.array(q, np.int64)), _grams(np.array(a, np.int64))) for _, q, a in rows]
        return cls(np.array([r[0] for r in rows]), max(len(q) + len(a) for _, q, a in rows), vocabulary, np.append(first, len(word)), item, weight, block_first, key[1][at], np.maximum.reduceat(weight, at), grams)

    def retrieve(self, words: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(document, passage start in words, item, score) of everything at RETRIEVE or more."""
        span = self.span
        doc = np.repeat(np.arange(len(lengths)), lengths)
        within = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == words
        doc, stripe, word = doc[known], within[known] // span, place[known]
        per_doc = lengths // span + 1
        base = np.cumsum(per_doc) - per_doc
        # a passage is its stripe of `span` words and the next one: each word falls into two passages
        stripes = base[doc] + stripe
        earlier = stripe > 0
        passage, word = np.concatenate([stripes, stripes[earlier] - 1]), np.concatenate([word, word[earlier]])
        key = np.unique(passage * np.int64(len(self.vocabulary)) + word)
        passage, word = key // len(self.vocabulary), key % len(self.vocabulary)
        n_blocks = (len(self.item_ids) + BLOCK_ITEMS - 1) // BLOCK_ITEMS
        hit, at = _spread(self.block_first, word)
        reach = _summed(passage[hit] * n_blocks + self.blocks[at], self.bounds[at])
        visited = np.sort(reach[0][reach[1] >= RETRIEVE - 1e-9])
        if not len(visited):
            return
        live = np.isin(passage, visited // n_blocks)
        passage, word = passage[live], word[live]
        hit, at = _spread(self.first, word)
        cell = passage[hit] * n_blocks + self.items[at] // BLOCK_ITEMS
        inside = visited[np.minimum(np.searchsorted(visited, cell), len(visited) - 1)] == cell
        cells, scores = _summed((passage[hit] * len(self.item_ids) + self.items[at])[inside], self.weights[at][inside])
        owner = np.repeat(np.arange(len(lengths)), per_doc)
        for cell, score in zip(cells[scores >= RETRIEVE].tolist(), scores[scores >= RETRIEVE].tolist()):
            p, item = divmod(cell, len(self.item_ids))
            yield int(owner[p]), int(p - base[owner[p]]) * span, item, score

    def overlaps(self, item: int, passage: np.ndarray) -> tuple[float, float, float]:
        """Shares of the question's, the answer's and all their shingles in the passage; an empty answer counts as 1."""
        have = set(_grams(passage).tolist())
        short = {len(g) for g in self.grams[item] if len(g) == 1}
        if short:  # a question or answer under five words is one shingle of its own length
            for n in range(1, WORDS):
                for k in range(len(passage) - n + 1):
                    have.add(int(_grams(passage[k : k + n])[0]))
        found = [sum(g in have for g in grams.tolist()) for grams in self.grams[item]]
        sizes = [len(g) for g in self.grams[item]]
        return found[0] / max(sizes[0], 1), found[1] / sizes[1] if sizes[1] else 1.0, sum(found) / max(sum(sizes), 1)


def _spread(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places first[r] .. first[r + 1] of each row r: (index into rows, place)."""
    n = first[rows + 1] - first[rows]
    hit = np.repeat(np.arange(len(rows)), n)
    return hit, np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, values
    low = keys.min()
    width = int(keys.max() - low) + 1
    if width <= 64 * len(keys) + 1024:
        sums = np.bincount(keys - low, values, width)
        at = np.flatnonzero(sums)
        return at + low, sums[at]
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, values)


def _parts(items: DataFrame) -> Iterator[Index]:
    """The index in parts of bounded size, each collected alone."""
    qa = with_question_and_answer(items).select("item_id", word_hashes(F.col("question")).alias("q"), word_hashes(F.col("answer")).alias("a"))
    qa = qa.where(F.size("q") + F.size("a") > 0).dropDuplicates(["item_id", "q", "a"])
    qa = written(qa.select(F.monotonically_increasing_id().alias("item"), "*", (F.size("q") + F.size("a")).alias("n")), "items")
    total = qa.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
    if not total.n:
        return
    df = qa.select(F.explode(F.array_distinct(F.concat("q", "a"))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    n_parts = math.ceil(total.words / PART_WORDS)
    for part in range(n_parts):
        own = qa.where(F.pmod(F.xxhash64("item"), F.lit(n_parts)) == part)
        rows = own.orderBy("item").collect()
        words = own.select(F.explode(F.array_distinct(F.concat("q", "a"))).alias("w")).distinct()
        if rows:
            index = Index.build([(r["item"], r.q, r.a) for r in rows], {r.w: r.df for r in df.join(words, "w").collect()}, total.n, total.words / total.n)
            index.public_ids = [r.item_id for r in rows]
            yield index


def _matches(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part, words, lengths in _chunks(batch):
                starts, ids, out = np.cumsum(lengths) - lengths, part.column("_id").to_pylist(), []
                for doc, at, item, score in index.retrieve(words, lengths):
                    passage = words[starts[doc] + at : min(starts[doc] + at + 2 * index.span, starts[doc] + lengths[doc])]
                    q, a, both = index.overlaps(item, passage)
                    if both >= OVERLAP and min(q, a) >= PART_OVERLAP:
                        out.append((ids[doc], int(index.item_ids[item]), index.public_ids[item], score, q, a))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.float64()] * 3)], ["_id", "item", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.mapInArrow(run, "_id long, item long, item_id long, score double, question_overlap double, answer_overlap double")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(_id, item_id, score, question_overlap, answer_overlap): each item that a document holds, its best passage."""
    words = docs.select(doc_key().alias("_id"), word_hashes(F.col("text")).alias("words"))
    found = None
    for index in _parts(items):
        hits = _matches(words, index)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "_id long, item_id long, score double, question_overlap double, answer_overlap double")
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("b")
    # items without an id are told apart by their number
    nameless = F.when(F.col("item_id").isNull(), F.col("item")).alias("nameless")
    return found.groupBy("_id", "item_id", nameless).agg(best).select("_id", "item_id", "b.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(doc_id_of(F.col("_id")).alias("doc_id"), "item_id", "score", "question_overlap", "answer_overlap")


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no item of the benchmark table."""
    bad = written(contaminated(docs, table(spark, sf_dir, "benchmark")).select("_id").distinct(), "contaminated")
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), doc_key().alias("_id"))
    return keyed.join(bad, "_id", "left_anti").select("_doc.*")


