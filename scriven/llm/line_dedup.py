"""Line dedup: lines found in many documents stay only in the last document that holds them.

A line's key is the line stripped of white space with A-Z lower-cased, as two independent 64-bit hashes.
`LineIndex` holds three tables: postings (key, document, place), exact reference counts per key, and
cuckoo filters, one per shard of keys, with the keys that are shared (in `min_docs` documents or more).
A document's lines are first looked up in the filter of their shard; only hits, a small share of all
lines, go on to the exact counts, so a filter's false hit costs one lookup and changes nothing.
Cuckoo filters can forget keys, so deleting documents undoes what inserting them did: counts fall, and a key
that falls under `min_docs` leaves its filter.

Defined cases: null or empty text is one empty line; keys under `min_chars` code points are never shared;
rows with one doc_id count as one document, a null doc_id as one document before all others; repeated
rows are treated alike; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, doc_id_of, doc_key, table, written

KEY = ("h1", "h2")
#: Keys a filter shard holds at most on average, and rows that one task looks up at once.
SHARD_KEYS, PROBE_ROWS = 1 << 16, 1 << 18
SLOTS, KICKS = 4, 500


class CuckooFilter:
    """16-bit fingerprints in buckets of four; `insert`, `delete` and `contains` take arrays of 64-bit hashes.

    A fingerprint sits in bucket i or in i XOR hash(fingerprint). Full buckets hand on a fingerprint; if that
    does not settle, `insert` returns False and the caller builds a larger filter from the exact counts.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        return cls(1 << max(1, math.ceil(math.log2(max(1, n) / (0.8 * SLOTS) + 1))))

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
        out = cls.sized(len(h1))
        while not out.insert(h1, h2):
            out = cls(out.buckets * 2)
        return out

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        table = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def _places(self, h1, h2):
        h1, h2 = np.asarray(h1).astype(np.uint64), np.asarray(h2).astype(np.uint64)
        print_ = ((h2 >> np.uint64(48)).astype(np.uint32) % np.uint32(65535) + np.uint32(1)).astype(np.uint16)
        first = ((h1 >> np.uint64(20)) & np.uint64(self.buckets - 1)).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, at, print_):
        return at ^ ((print_.astype(np.int64) * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def contains(self, h1, h2) -> np.ndarray:
        print_, a, b = self._places(h1, h2)
        return (self.table[a] == print_[:, None]).any(1) | (self.table[b] == print_[:, None]).any(1)

    def _settle(self, at, print_) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets; returns the places (in the arrays) of those without one."""
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(sorted_at, sorted_at)
        free = self.table[sorted_at] == 0
        fits = rank < free.sum(1)
        slot = np.argmax((np.cumsum(free, 1) == (rank + 1)[:, None]) & free, 1)
        self.table[sorted_at[fits], slot[fits]] = print_[order[fits]]
        return order[~fits]

    def insert(self, h1, h2) -> bool:
        print_, a, b = self._places(h1, h2)
        left = self._settle(a, print_)
        left = left[self._settle(b[left], print_[left])]
        at, print_ = b[left], print_[left]
        for turn in range(KICKS):
            if not len(at):
                return True
            # one newcomer a bucket takes a slot; who sat there moves to the other bucket
            _, one = np.unique(at, return_index=True)
            slot = (print_[one].astype(np.int64) + turn) % SLOTS
            out = self.table[at[one], slot].copy()
            self.table[at[one], slot] = print_[one]
            rest = np.setdiff1d(np.arange(len(at)), one)
            at, print_ = np.concatenate([at[rest], self._other(at[one], out)]), np.concatenate([print_[rest], out])
            left = self._settle(at, print_)
            at, print_ = at[left], print_[left]
        return not len(at)

    def delete(self, h1, h2) -> None:
        for print_, a, b in zip(*self._places(h1, h2), strict=True):
            for at in (a, b):
                if len(hit := np.flatnonzero(self.table[at] == print_)):
                    self.table[at, hit[0]] = 0
                    break


def line_key(line: Column) -> Column:
    """The line stripped at both ends, A-Z lower-cased; other letters stay."""
    return F.translate(F.btrim(line, F.lit(SPACES)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _row() -> list[Column]:
    """Names a text among rows that share a doc_id, so that line places never mix."""
    return [doc_key().alias("_id"), F.xxhash64(_text()).alias("_version")]


def postings(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(_id, _version, pos, h1, h2) for each line whose key has min_chars code points or more."""
    keys = F.transform(F.split(_text(), "\n"), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("pos")))
    lines = docs.select(*_row(), F.explode(F.filter(keys, lambda x: F.length(x.key) >= min_chars)).alias("l"))
    return lines.select("_id", "_version", "l.pos", F.xxhash64("l.key").alias("h1"), F.xxhash64(F.lit(1), "l.key").alias("h2"))


def reference_counts(posted: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, last_doc): exact; a document counts once, and counting starts before the shuffle."""
    return posted.select(*KEY, "_id").distinct().groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("_id").alias("last_doc"))


def _shard(n: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(n)).cast("int")


class LineIndex:
    """Incremental: `insert` and `delete` take documents; `lookup` finds which of their lines are shared."""

    def __init__(self, spark: SparkSession, min_docs: int = 3, min_chars: int = 20):
        self.spark, self.min_docs, self.min_chars = spark, min_docs, min_chars
        self.posted = self.counts = self.filters = None
        self.shards = 0

    def insert(self, docs: DataFrame) -> None:
        new = written(postings(docs, self.min_chars), "line-postings")
        self._become(new if self.posted is None else self.posted.unionByName(new), new)

    def delete(self, docs: DataFrame) -> None:
        gone = docs.select(doc_key().alias("_id")).distinct()
        touched = self.posted.join(gone, "_id", "left_semi")
        self._become(written(self.posted.join(gone, "_id", "left_anti"), "line-postings"), written(touched, "line-gone"))

    def _become(self, posted: DataFrame, touched: DataFrame) -> None:
        before = self.counts
        if before is None:
            counts = reference_counts(posted)
        else:  # only the keys that the change touches are counted anew
            keys = touched.select(*KEY).distinct()
            counts = before.join(keys, list(KEY), "left_anti").unionByName(reference_counts(posted.join(keys, list(KEY), "left_semi")))
        self.posted, self.counts = posted, written(counts, "line-counts")
        shared = self.shared()
        wanted = 1 << max(0, math.ceil(math.log2(max(1, shared.count() / SHARD_KEYS))))
        if before is None or wanted > 2 * self.shards:
            self.shards = wanted
            built = shared.select(_shard(wanted).alias("shard"), *KEY).groupBy("shard").applyInPandas(_build, "shard int, filter binary")
        else:
            was = before.where(F.col("n_docs") >= self.min_docs).select(*KEY)
            moves = shared.select(*KEY).exceptAll(was).withColumn("add", F.lit(True)).unionByName(was.exceptAll(shared.select(*KEY)).withColumn("add", F.lit(False)))
            moves = moves.select(_shard(self.shards).alias("shard"), *KEY, "add")
            # a filter that overflows is built from the counts again: its shard's shared keys come along
            built = self._filled(moves, shared)
        self.filters = written(built, "line-filters")

    def _filled(self, moves: DataFrame, shared: DataFrame) -> DataFrame:
        changed = self.filters.select("shard", "filter").groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(_change, "shard int, filter binary")
        full = written(changed, "line-changed")
        again = shared.select(_shard(self.shards).alias("shard"), *KEY).join(full.where("filter IS NULL").select("shard"), "shard", "left_semi")
        return full.where("filter IS NOT NULL").unionByName(again.groupBy("shard").applyInPandas(_build, "shard int, filter binary"))

    def shared(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    def lookup(self, posted: DataFrame) -> DataFrame:
        """Postings whose key is shared, with last_doc: filter first, then the exact counts."""
        # the rows of a shard are dealt over `salts` tasks, each with the shard's filter, so a hot key is split
        salts = max(1, math.ceil(posted.count() / (self.shards * PROBE_ROWS)))
        rows = posted.select(_shard(self.shards).alias("shard"), F.pmod(F.xxhash64("_id", "pos"), F.lit(salts)).cast("int").alias("salt"), *posted.columns)
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "filter")
        hits = rows.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInPandas(_probe, posted.schema)
        return hits.join(self.shared(), list(KEY))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    f = CuckooFilter.of(pdf.h1.to_numpy(), pdf.h2.to_numpy())
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [f.to_bytes()]})


def _change(old: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
    shard = (old if len(old) else moves)["shard"].iloc[0]
    f = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(len(moves))
    gone, new = moves[~moves["add"].astype(bool)], moves[moves["add"].astype(bool)]
    f.delete(gone.h1.to_numpy(), gone.h2.to_numpy())
    fits = f.insert(new.h1.to_numpy(), new.h2.to_numpy())
    return pd.DataFrame({"shard": [shard], "filter": [f.to_bytes() if fits else None]})


def _probe(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    out = rows.drop(columns=["shard", "salt"])
    if not len(rows) or not len(filters):
        return out.iloc[:0]
    f = CuckooFilter.from_bytes(filters["filter"].iloc[0])
    return out[f.contains(rows.h1.to_numpy(), rows.h2.to_numpy())]


def without_shared_lines(docs: DataFrame, index: LineIndex, posted: DataFrame | None = None) -> DataFrame:
    """docs with _lines, _kept (the lines that stay, in order) and _n_dropped; posted: the postings of docs if at hand."""
    hits = index.lookup(posted if posted is not None else written(postings(docs, index.min_chars), "line-postings"))
    drops = hits.where(F.col("_id") != F.col("last_doc")).groupBy("_id", "_version").agg(F.collect_set("pos").alias("_drop"))
    own = docs.select(F.struct(*docs.columns).alias("_doc"), *_row(), F.split(_text(), "\n").alias("_lines"))
    out = own.join(drops, ["_id", "_version"], "left").withColumn("_at", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_drop", F.array().cast("array<int>"))))
    return out.select("_doc", "_id", "_lines", F.transform("_at", lambda i: F.get(F.col("_lines"), i)).alias("_kept"), (F.size("_lines") - F.size("_at")).alias("_n_dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    index = LineIndex(docs.sparkSession, min_docs, min_chars)
    index.insert(docs)
    return without_shared_lines(docs, index, index.posted)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(doc_id_of(F.col("_id")).alias("doc_id"), F.size("_lines").cast("long").alias("n_lines"), F.col("_n_dropped").cast("long").alias("n_dropped"), F.sha2(F.array_join("_kept", "\n"), 256).alias("kept_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, their text without the shared lines, n_chars brought in line."""
    text = F.array_join("_kept", "\n")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return dedup_lines(docs).select(*(new[c].alias(c) if c in new else F.col("_doc")[c].alias(c) for c in docs.columns))


_SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line,
         translate(trim(l[i], {_SPACES_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), shared AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.*, s.key IS NOT NULL AND l.doc_id <> s.last_doc AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
