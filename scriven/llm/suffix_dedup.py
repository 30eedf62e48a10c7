"""Exact removal of repeated 100-byte strings with suffix arrays over shards.

Candidates: each 100-byte window is known by its anchor, the 24-byte string in it of least hash (leftmost of
equals), so equal windows have equal anchors at equal places. Windows in a row with one anchor form a context.
Anchors seen once are dropped after a count; of equal contexts only the first occurrence goes on, the others
are repeats as a whole. The contexts of an anchor meet in one shard, where a suffix array over their bytes
is built by induced sorting: suffixes are classified, the leftmost-smaller substrings sorted and named,
their order found from the names, and all suffixes induced from it, bucket by bucket in array operations; names are
ordered by doubling to a depth of 64 names, over 128 bytes. Permuted common prefixes, compared only where they
do not follow from the place before, then show which windows are equal; all but the first occurrence go.
An anchor with more than HOT contexts is not one shard's: its windows are grouped by their own digest.

Equal contexts are found by 128 bits of hashes (anchor and content).

Defined cases: null text is empty; a null doc_id comes before all others; different texts of one doc_id (or of none) are
documents of their own, in order of a hash of the text; rows of one doc_id and equal text are one document, each given back
alike; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_id_of, doc_key, shuffle_partitions, table, written
from .near_dedup import mixed

LENGTH, ANCHOR = 100, 24
# CHUNK_BYTES: hashes of so many places stay in a core's cache
HOT, SHARD_BYTES, CHUNK_BYTES, DEPTH = 20_000, 1 << 21, 1 << 17, 64
SEPARATOR = 0xFF  # no byte of UTF-8


# --- suffix arrays


def _ranked(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stable order, rank within its value, distinct values, counts)"""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    counts = np.diff(np.append(first, len(c)))
    return order, np.arange(len(c)) - np.repeat(first, counts), c[first], counts


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All suffixes from the leftmost-smaller ones in the order given."""
    end = np.cumsum(size)
    start, sa = end - size, np.full(len(s), -1, np.int32)
    order, rank, values, counts = _ranked(s[lms])
    n_lms = np.zeros(len(size), np.int64)
    n_lms[values] = counts
    sa[np.repeat(end[values] - counts, counts) + rank] = lms[order]
    head = start.copy()

    def larger(batch: np.ndarray) -> None:
        p = batch[batch > 0] - 1
        p = p[~smaller[p]]
        if len(p):
            order, rank, values, counts = _ranked(s[p])
            sa[np.repeat(head[values], counts) + rank] = p[order]
            head[values] += counts

    for c in range(len(size)):
        at = start[c]
        while at < head[c]:
            stop = head[c]
            larger(sa[at:stop])
            at = stop
        if n_lms[c]:
            larger(sa[end[c] - n_lms[c] : end[c]])
    tail = end.copy()

    def lesser(batch: np.ndarray) -> None:
        p = batch[batch > 0] - 1
        p = p[smaller[p]][::-1]
        if len(p):
            order, rank, values, counts = _ranked(s[p])
            sa[np.repeat(tail[values], counts) - 1 - rank] = p[order]
            tail[values] -= counts

    for c in range(len(size) - 1, -1, -1):
        at = end[c]
        while at > tail[c]:
            stop = tail[c]
            lesser(sa[stop:at])
            at = stop
        lesser(sa[start[c] : head[c]])
    sa[0] = len(s) - 1
    return sa


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of names by their first DEPTH names."""
    n, rank, k = len(names), names.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        k *= 2
        if k >= min(DEPTH, n) or rank[order[-1]] == n - 1:
            return order


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of data (bytes) in the order of their suffixes, exact to over 2 * DEPTH bytes."""
    s = np.zeros(len(data) + 1, np.int16)
    s[:-1] = data.astype(np.int16) + 1
    n, change = len(s), np.sign(np.diff(s))
    at = np.where(change != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place that differs from its successor
    smaller = np.ones(n, bool)
    smaller[:-1] = change[np.minimum(at, n - 2)] > 0
    size = np.bincount(s, minlength=257)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    if len(lms) > 1:
        first = _induce(s, smaller, lms, size)
        flag = np.zeros(n, bool)
        flag[lms] = True
        by_substring = first[flag[first]]
        length = np.zeros(n, np.int32)
        length[lms[:-1]] = np.diff(lms) + 1
        a, b = by_substring[:-1], by_substring[1:]
        same = length[a] == length[b]
        live, k = np.flatnonzero(same), 0
        while len(live):
            equal = s[a[live] + k] == s[b[live] + k]
            same[live[~equal]] = False
            k += 1
            live = live[equal]
            live = live[length[a[live]] > k]
        name = np.zeros(n, np.int64)
        name[by_substring] = np.cumsum(np.concatenate([[0], ~same]))
        lms = lms[_doubled(name[lms])]
    return _induce(s, smaller, lms, size)[1:]


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray, most: int = 256) -> np.ndarray:
    """At each place, how many bytes its suffix shares with the one before it in order, up to `most`."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)  # the others share one byte less than the place to their left
    own[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (data[:-1] == SEPARATOR) | (data[:-1] != data[before[:-1]])
    p = np.flatnonzero(own & (before >= 0))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded.tobytes(), 0, (1,))
    out = np.zeros(n, np.int64)
    live, depth = p, 0
    while len(live) and depth < most:
        a, b = live + depth, before[live] + depth
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        whole = differ == 0
        low = differ[~whole] & (~differ[~whole] + np.uint64(1))
        bits = np.log2(low.astype(np.float64)).astype(np.int64)
        out[live[~whole]] = depth + bits // 8
        out[live[whole]] = depth + 8
        live, depth = live[whole], depth + 8
    out = np.minimum(out, n - np.maximum(np.arange(n), before))
    place = np.arange(n)
    base = np.maximum.accumulate(np.where(own, place, 0))
    return np.maximum(out[base] - (place - base), 0)


def repeats_in_shard(contexts: list[bytes], docs: np.ndarray, subs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, its text, start, stop) of the bytes of windows in contexts that start earlier in another of them."""
    data = np.frombuffer(b"".join([c + bytes([SEPARATOR]) for c in contexts]), np.uint8)
    lengths = np.array([len(c) + 1 for c in contexts])
    of = np.repeat(np.arange(len(contexts)), lengths)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    window = inside + LENGTH < lengths[of]
    sa = suffix_array(data)
    group = np.cumsum(permuted_common_prefixes(data, sa)[sa] < LENGTH)
    at, group = sa[window[sa]], group[window[sa]]
    # where a window starts: its document's rank above, its place there below
    order = np.lexsort((subs, docs))
    new = np.zeros(len(order), np.int64)
    new[1:] = (docs[order][1:] != docs[order][:-1]) | (subs[order][1:] != subs[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    start = (rank[of[at]] << 40) + starts[of[at]] + inside[at]
    edge = np.ones(len(at), bool)
    edge[1:] = group[1:] != group[:-1]
    low = np.flatnonzero(edge)
    least = np.minimum.reduceat(start, low) if len(low) else start
    gone = np.sort(at[start != np.repeat(least, np.diff(np.append(low, len(at))))])
    edge = np.ones(len(gone), bool)
    edge[1:] = (np.diff(gone) != 1) | (of[gone[1:]] != of[gone[:-1]])
    low = np.flatnonzero(edge)
    high = np.append(low[1:], len(gone)) - 1
    a, b = gone[low], gone[high] if len(gone) else gone
    return docs[of[a]], subs[of[a]], starts[of[a]] + inside[a], starts[of[a]] + inside[b] + LENGTH


# --- anchors


#: The hash of each byte.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(data: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """64-bit hashes of all strings of 1, 2, 4, .. bytes of data, none over `longest`, by doubling."""
    powers, size = {1: BYTES[data]}, 1
    with np.errstate(over="ignore"):
        while size * 2 <= longest:
            h = powers[size]
            powers[size * 2] = h[:-size] * np.uint64(0xD6E8FEB86659FD93 + 2 * size) + h[size:]
            size *= 2
    return powers


def _grown(powers: dict[int, np.ndarray], length: int, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the `length` bytes at each place, or at those given."""
    total, out, done = len(powers[1]), None, 0
    with np.errstate(over="ignore"):
        for size in sorted(powers, reverse=True):
            if done + size <= length:
                h = powers[size][done : total - length + done + 1] if at is None else powers[size][at + done]
                out = h if out is None else out * np.uint64(0xA0761D6478BD642F) + h
                done += size
    return mixed(out)


def anchors(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, windows, anchor, content) of each context of documents whose bytes lie one after another."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    powers = _powers(data, LENGTH)
    h = _grown(powers, ANCHOR)
    # hash above, place below: the least is the leftmost of the least hashes
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span, size = LENGTH - ANCHOR + 1, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    at = np.flatnonzero(doc[: len(low)] == doc[LENGTH - 1 :])
    where = (low[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (where[1:] != where[:-1]) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start = at[first]
    content = mixed(_grown(powers, LENGTH, start) ^ mixed(_grown(powers, LENGTH, start + n - 1) + n.astype(np.uint64)))
    begins = np.cumsum(lengths) - lengths
    return doc[start], start - begins[doc[start]], n, h[where[first]], content


def _byte_chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Documents in parts of about CHUNK_BYTES, one longer document alone; (first row, texts)."""
    texts, start, size = [], 0, 0
    for i, t in enumerate(batch.column("text").to_pylist()):
        texts.append(t.encode())
        size += len(texts[-1])
        if size >= CHUNK_BYTES:
            yield start, texts
            texts, start, size = [], i + 1, 0
    if texts:
        yield start, texts


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, subs = np.asarray(batch.column("_id")), np.asarray(batch.column("_sub"))
        for start, texts in _byte_chunks(batch):
            # a document over CHUNK_BYTES is cut into pieces that overlap by all but one byte of a window
            pieces, owner, offset = [], [], []
            for i, t in enumerate(texts):
                for a in range(0, max(len(t) - LENGTH + 1, 1), CHUNK_BYTES):
                    pieces.append(t[a : a + CHUNK_BYTES + LENGTH - 1])
                    owner.append(start + i)
                    offset.append(a)
            owner, offset, k = np.array(owner), np.array(offset), 0
            while k < len(pieces):
                stop, size = k, 0
                while stop < len(pieces) and (stop == k or size + len(pieces[stop]) < 2 * CHUNK_BYTES):
                    size += len(pieces[stop])
                    stop += 1
                doc, at, n, h, content = anchors(np.frombuffer(b"".join(pieces[k:stop]), np.uint8), np.array([len(p) for p in pieces[k:stop]]))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[owner[k + doc]]), pa.array(subs[owner[k + doc]]), pa.array((offset[k + doc] + at) << 8 | n)], ["anchor", "content", "_id", "_sub", "extent"])
                k = stop


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"anchor": [], "_id": [], "_sub": [], "start": [], "bytes": []}
        for key, sub, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("_id", "_sub", "text", "wanted"))):
            raw = text.encode()
            for w in wanted:
                start, n = w["extent"] >> 8, w["extent"] & 255
                piece = raw[start : start + n + LENGTH - 1]
                for c, v in zip(out, (w["anchor"], key, sub, start, piece)):
                    out[c].append(v)
        yield pa.RecordBatch.from_pydict({"anchor": pa.array(out["anchor"], pa.int64()), "_id": pa.array(out["_id"], pa.int64()), "_sub": pa.array(out["_sub"], pa.int64()), "start": pa.array(out["start"], pa.int64()), "bytes": pa.array(out["bytes"], pa.binary())})


def _shard_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: shards of about SHARD_BYTES that never part an anchor."""
    held, size, last = [], 0, None

    def solved():
        docs, subs, starts = (np.array([r[k] for r in held], np.int64) for k in (1, 2, 3))
        out = repeats_in_shard([r[4] for r in held], docs, subs, starts)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["_id", "_sub", "start", "stop"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "_id", "_sub", "start", "bytes"))):
            if size >= SHARD_BYTES and row[0] != last:
                yield solved()
                held, size = [], 0
            held.append(row)
            size += len(row[4]) + 1
            last = row[0]
    if held:
        yield solved()


SPAN = "_id long, _sub long, start long, stop long"
DOC = ["_id", "_sub"]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs(_id, _sub, text), each once, to (_id, _sub, start, stop): bytes under a window that also starts earlier; spans may overlap."""
    found = docs.mapInArrow(_anchor_rows, "anchor long, content long, _id long, _sub long, extent long")
    again = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    seen = written(found.join(again, "anchor", "left_semi"), "anchors")
    place = F.struct(*DOC, "extent")
    first = written(seen.groupBy("anchor", "content").agg(F.min(place).alias("first"), F.count("*").alias("n")), "contexts")
    copies = seen.join(first.where("n > 1").drop("n"), ["anchor", "content"]).where(place != F.col("first"))
    start = F.shiftright("extent", 8)
    spans = copies.select(*DOC, start.alias("start"), (start + F.col("extent").bitwiseAND(255) + LENGTH - 1).alias("stop"))

    several = first.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1")
    wanted = first.join(several, "anchor").select("first._id", "first._sub", F.struct("anchor", "first.extent").alias("w"))
    per_doc = wanted.groupBy(*DOC).agg(F.collect_list("w").alias("wanted"))
    contexts = docs.join(per_doc, DOC).mapInArrow(_cut_contexts, "anchor long, _id long, _sub long, start long, bytes binary")
    contexts = written(contexts, "context-bytes")
    hot = written(several.where(F.col("contexts") > HOT).select("anchor"), "hot-anchors")
    shards = contexts.join(hot, "anchor", "left_anti").repartition(shuffle_partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor")
    spans = spans.unionByName(shards.mapInArrow(_shard_spans, SPAN))
    windows = contexts.join(hot, "anchor", "left_semi").select(*DOC, "start", "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - LENGTH)).alias("k"))
    windows = windows.select(*DOC, (F.col("start") + F.col("k")).alias("start"), F.sha2(F.substring("bytes", F.col("k") + 1, F.lit(LENGTH)), 256).alias("window"))
    at = F.struct(*DOC, "start")
    earliest = windows.groupBy("window").agg(F.min(at).alias("first"))
    later = windows.join(earliest, "window").where(at != F.col("first"))
    return spans.unionByName(later.select(*DOC, "start", (F.col("start") + LENGTH).alias("stop")))


def _remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {c: [] for c in ("_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for key, text, spans in zip(*(batch.column(c).to_pylist() for c in ("_id", "text", "spans"))):
            raw = text.encode()
            runs: list[list[int]] = []
            for a, b in sorted((s["start"], min(s["stop"], len(raw))) for s in spans or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                elif a < b:
                    runs.append([a, b])
            cuts = [0, *(x for r in runs for x in r), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
            for c, v in zip(out, (key, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)):
                out[c].append(v)
        kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
        yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def without_repeats(docs: DataFrame) -> DataFrame:
    """(_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row of docs."""
    own = docs.select(doc_key().alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_sub", F.xxhash64("text"))
    # rows of one doc_id and equal text are one document: only such ids are told apart, so texts are not shuffled for it
    twice = written(own.groupBy(*DOC).agg(F.count("*").alias("n")).where("n > 1").select(*DOC), "repeated-rows")
    single = own.join(twice, DOC, "left_anti").unionByName(own.join(twice, DOC).dropDuplicates(DOC)) if twice.limit(1).count() else own
    spans = written(repeated_spans(single), "spans").groupBy(*DOC).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return own.join(spans, DOC, "left").select("_id", "text", "spans").mapInArrow(_remaining, "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(doc_id_of(F.col("_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every window of every text by its digest; bytes are pairs of hexadecimal digits.
OP1_SQL = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, i) AS n FROM w) WHERE n > 1),
m AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m) GROUP BY doc_id, run),
g AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM s UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), max(length(h)) // 2 FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM s GROUP BY doc_id),
p AS (SELECT d.doc_id, string_agg(substr(h, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS kept FROM d JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN p USING (doc_id) LEFT JOIN c USING (doc_id)"""
