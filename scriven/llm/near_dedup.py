"""Near-duplicate classes by ProbMinHash over weighted five-word shingles.

A shingle's weight is how often it occurs; the similarity is the probability Jaccard
J_P(x, y) = sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i), plain Jaccard where no shingle
repeats; 1 - J_P is a metric. Each shingle sends a Poisson process of arrivals at its weight's rate, seeded by
the shingle alone; each arrival names a register, which keeps the earliest; a process stops once it is later
than all registers of its document. Two documents agree in a register with probability J_P.

1. Equal texts become one row. 2. Signatures; documents that agree in a band of registers share a bucket.
3. Inside a bucket of three or more leaders are chosen by estimated similarity and each member joins every leader
that a link could run through (LINKABLE); a bucket's joined members, one edge each, form candidate groups. 4. A group is verified with
whole shingle sets: documents are compared until they are known to be in one class or known not to be
linked. Groups over GROUP_DOCS are dealt over blocks; the documents outside a group's largest class so far then
meet its blocks, spread over tasks (_large_links). 5. Classes are the components of the verified links.

With 32 bands of 5 registers a pair at 0.8 shares no band with probability 3e-6. No bucket, group or partner list is capped.

Defined cases: words are lower-cased, between ASCII white space; a text of one to four words is one shingle;
texts without words are alike only if equal; null text is empty text; rows with one doc_id (or none) and equal text
are one document, different texts of one doc_id (or none) are different documents; the class id is the smallest doc_id
of the class, null first, so classes that share a null or repeated doc_id may bear one id, but each has one
representative; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, doc_id_of, doc_key, table, written
from .components import components

WORDS, BANDS, ROWS = 5, 32, 5
REGISTERS = BANDS * ROWS
SIMILARITY = 0.8
#: Six standard errors of a register estimate: what a pair at a given similarity can fall short of.
SLACK = 6 * (0.25 / REGISTERS) ** 0.5
#: A member within 0.5 of a leader; a link of it (distance 0.2) is then within 0.7 of that leader.
NEAR, LINKABLE = 0.5, max(0.02, 0.3 - SLACK)
#: Groups up to this many documents are verified in one task; words worked on at once in a task.
GROUP_DOCS, CHUNK_WORDS = 4096, 200_000
#: Classes of a large group of which one document each meets the whole group first.
LEADERS = 8


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit mix (xor, shift, multiply) of each element."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight), sorted, for documents whose word hashes lie one after another."""
    counts = np.where(lengths > 0, np.maximum(lengths - WORDS + 1, 1), 0)
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), counts)
    at = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    end = np.repeat(starts + lengths, counts)
    h = np.full(len(at), 7, np.uint64)
    words = words.astype(np.uint64)
    for k in range(WORDS):
        inside = at + k < end
        w = words[np.where(inside, at + k, 0)] if len(words) else np.zeros(0, np.uint64)
        h = mixed(h ^ np.where(inside, w, np.uint64(0)), k + 1)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    edge = np.flatnonzero(first)
    return doc[edge], h[edge], np.diff(np.append(edge, len(h)))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x REGISTERS: the shingle that arrives first in each register; rows of documents without shingles are 0."""
    m = REGISTERS
    when, who = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    t, turn = np.zeros(len(h)), 0
    while len(h):
        turn += 1
        r = mixed(h, turn)
        t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        at = doc * m + (mixed(r, 99) % np.uint64(m)).astype(np.int64)
        np.minimum.at(when, at, t)
        won = when[at] == t
        who[at[won]] = h[won]
        on = t < when.reshape(n, m).max(1)[doc]
        doc, h, weight, t = doc[on], h[on], weight[on], t[on]
    return who.reshape(n, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        key = mixed(key ^ sig[:, r::ROWS], r + 1)
    return mixed(key ^ np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], 77)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about CHUNK_WORDS words each, with their word hashes and lengths."""
    words = batch.column("words")
    offsets = np.asarray(words.offsets).astype(np.int64)
    values = np.asarray(words.values).view(np.uint64)
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK_WORDS, "right")) - 1)
        yield batch.slice(start, stop - start), values[offsets[start] : offsets[stop]], np.diff(offsets[start : stop + 1])
        start = stop


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words, lengths in _chunks(batch):
            sig = signatures(*shingles(words, lengths), len(lengths))
            keys = band_keys(sig)
            keep = np.where(lengths > 0, BANDS, 0)
            ends = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
            flat = keys[lengths > 0].reshape(-1).view(np.int64)
            short = (sig & np.uint64(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_text"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([x.tobytes() for x in short], pa.binary())], ["_id", "_text", "bands", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's shingles and weights, as bytes."""
    for batch in batches:
        for part, words, lengths in _chunks(batch):
            doc, h, weight = shingles(words, lengths)
            cut = np.searchsorted(doc, np.arange(len(lengths) + 1))
            sets = [h[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            weights = [b"" if (w := weight[a:b]).max(initial=1) == 1 else w.astype(np.uint32).tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("grp"), part.column("sig"), pa.array(sets, pa.binary()), pa.array(weights, pa.binary())], ["_id", "grp", "sig", "items", "weights"])


def _words():
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
    return F.transform(words, lambda w: F.xxhash64(w))


def similarity(a: tuple[np.ndarray, np.ndarray | None], b: tuple[np.ndarray, np.ndarray | None]) -> float:
    """J_P of two documents, each (sorted shingles, weights or None where all are 1)."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    place = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    common = hb[place] == ha
    n = int(common.sum())
    if (wa is None and wb is None) or not n:
        return n / (len(ha) + len(hb) - n)
    wa, wb = (np.ones(len(h)) if w is None else w.astype(float) for h, w in ((ha, wa), (hb, wb)))
    x, y = wa[common], wb[place[common]]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    # sum_j max(x_j / x_i, y_j / y_i): with j ordered by y_j / x_j, those up to i give x_j / x_i, the rest y_j / y_i
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    below, above = np.cumsum(x), y.sum() - np.cumsum(y)
    return float((1 / ((only_a + below) / x + (only_b + above) / y)).sum())


class _Group:
    """Documents of a candidate group, by id, with their shingle sets."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("_id")
        self.ids = pdf["_id"].to_numpy()
        if "label" in pdf:
            self.label, self.probes = pdf["label"].to_numpy().copy(), pdf["probes"].to_numpy(bool)
        self.sig = np.stack([np.frombuffer(s, np.uint16) for s in pdf["sig"]])
        self.sets = [(np.frombuffer(i, np.uint64), np.frombuffer(w, np.uint32) if len(w) else None) for i, w in zip(pdf["items"], pdf["weights"])]

    def links(self) -> list[tuple[int, int]]:
        """Links that connect all linked documents: pairs already in one class need no comparison."""
        n = len(self.ids)
        label, out = np.arange(n), []
        for i in range(n):
            rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            if not len(rest):
                continue
            rest = rest[(self.sig[rest] == self.sig[i]).mean(1) >= SIMILARITY - SLACK]
            for j in rest:
                if label[j] != label[i] and similarity(self.sets[i], self.sets[j]) >= SIMILARITY:
                    out.append((self.ids[i], self.ids[j]))
                    label[label == label[j]] = label[i]
        return out


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(_Group(pdf).links(), columns=["a", "b"]).astype("int64")


def _cross(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between probes and the other documents of a block: pairs already in one class need no comparison."""
    if pdf["is_probe"].nunique() < 2:
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    probe, base, out = _Group(pdf[pdf["is_probe"]]), _Group(pdf[~pdf["is_probe"]]), []
    for i in range(len(probe.ids)):
        # a base document that is a probe itself meets the smaller probes only: each pair is compared once
        rest = np.flatnonzero((base.label != probe.label[i]) & (~base.probes | (base.ids > probe.ids[i])))
        rest = rest[(base.sig[rest] == probe.sig[i]).mean(1) >= SIMILARITY - SLACK]
        for j in rest:
            old, new = base.label[j], probe.label[i]
            if old != new and similarity(probe.sets[i], base.sets[j]) >= SIMILARITY:
                out.append((probe.ids[i], base.ids[j]))
                base.label[base.label == old] = new
                probe.label[probe.label == old] = new
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _leaders(pdf: pd.DataFrame) -> pd.DataFrame:
    """Members of a bucket (or a part of it) that leaders join, see LINKABLE: an edge from each to the smallest of its set."""
    pdf = pdf.sort_values("_id")
    ids, sig = pdf["_id"].to_numpy(), np.stack([np.frombuffer(s, np.uint16) for s in pdf["sig"]])
    open_, label = np.ones(len(ids), bool), np.arange(len(ids))
    while open_.any():
        lead = int(np.argmax(open_))
        near = (sig == sig[lead]).mean(1)
        open_[lead] = False
        open_ &= near < NEAR
        joined = np.unique(label[near >= LINKABLE])
        label[np.isin(label, joined)] = joined[0]
    inner = label != np.arange(len(ids))
    return pd.DataFrame({"a": ids[label[inner]], "b": ids[inner]}).astype("int64")


def candidate_groups(signed: DataFrame) -> DataFrame:
    """signed(_id, bands, sig) to (_id, grp): documents that links could join."""
    at = signed.select("_id", F.explode("bands").alias("bucket"))
    buckets = at.groupBy("bucket").agg(F.count("*").alias("n"), F.min("_id").alias("low"), F.max("_id").alias("high"), F.sum(F.xxhash64("_id") % 2**40).alias("sum1"), F.sum(F.xxhash64(F.lit(1), "_id") % 2**40).alias("sum2")).where("n > 1")
    # buckets with the same members (two sums of hashes, the count and the smallest id agree) are looked at once
    buckets = written(buckets.groupBy("n", "low", "high", "sum1", "sum2").agg(F.min("bucket").alias("bucket")), "buckets")
    pairs = buckets.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct()
    members = written(at.join(buckets.where("n > 2").select("bucket", "n"), "bucket"), "bucket-members")
    # a bucket over GROUP_DOCS is dealt over parts, each with the bucket's smallest document as a common member
    parts = F.ceil(F.col("n") / GROUP_DOCS).cast("int")
    dealt = members.select("_id", "bucket", F.pmod(F.xxhash64("_id"), parts).cast("int").alias("part"))
    big = members.where(F.col("n") > GROUP_DOCS).groupBy("bucket", "n").agg(F.min("_id").alias("_id"))
    common = big.select("_id", "bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = dealt.unionByName(common).distinct().join(signed.select("_id", "sig"), "_id")
    edges = dealt.groupBy("bucket", "part").applyInPandas(_leaders, "a long, b long")
    # parts of a large bucket stay one candidate group
    whole = big.select("bucket", F.col("_id").alias("a")).join(members, "bucket").select("a", F.col("_id").alias("b"))
    return components(pairs.union(edges).union(whole)).select(F.col("id").alias("_id"), F.col("label").alias("grp"))


def _crossed(large: DataFrame, labels: DataFrame, probes: DataFrame) -> DataFrame:
    """Links between probes(_id) and all documents of their groups, in tasks of about GROUP_DOCS documents."""
    block = max(GROUP_DOCS // 2, 1)
    found = probes.select("_id", F.lit(True).alias("probes"))
    docs = large.join(labels.select(F.col("id").alias("_id"), "label"), "_id", "left").withColumn("label", F.coalesce("label", "_id"))
    docs = written(docs.join(found, "_id", "left").withColumn("probes", F.coalesce("probes", F.lit(False))), "probed")
    chunks = docs.where("probes").groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    docs = docs.join(chunks, "grp")
    columns = ["grp", "chunk", "part", "is_probe", "_id", "label", "probes", "sig", "items", "weights"]
    base = docs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("is_probe", F.lit(False))
    probe = docs.where("probes").withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "_id"), F.col("chunks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("is_probe", F.lit(True))
    return probe.select(columns).union(base.select(columns)).groupBy("grp", "chunk", "part").applyInPandas(_cross, "a long, b long")


def _largest(large: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(grp, label) of the k classes of each group that have most documents so far."""
    at = large.select("_id", "grp").join(labels.select(F.col("id").alias("_id"), "label"), "_id", "left").groupBy("grp", F.coalesce("label", "_id").alias("label")).agg(F.count("*").alias("n"))
    return at.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "label"))).where(F.col("k") <= k).select("grp", "label")


def _large_links(large: DataFrame) -> DataFrame:
    """Links that connect all linked documents of groups over GROUP_DOCS; large has n, the size of the group.

    Blocks of a group are verified alone. One document of each of the LEADERS largest classes then meets all blocks,
    which joins what is one class in most of them. At last each document outside the group's largest class meets all
    blocks: a pair in different classes has such a document. No task takes much more than GROUP_DOCS documents.
    """
    parts = F.ceil(F.col("n") / max(GROUP_DOCS // 2, 1)).cast("int")
    large = written(large.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int")).drop("n"), "large-groups")
    inner = written(large.groupBy("grp", "part").applyInPandas(_verify, "a long, b long"), "block-links")
    labels = components(inner)
    leaders = _largest(large, labels, LEADERS).select(F.col("label").alias("_id"))
    links = written(inner.union(_crossed(large, labels, leaders)), "leader-links")
    labels = components(links)
    main = _largest(large, labels, 1).select(F.col("label").alias("id"), "label")
    inside = main.select("id").union(labels.join(main.select("label"), "label", "left_semi").select("id"))
    return links.union(written(_crossed(large, labels, large.select("_id").join(inside.withColumnRenamed("id", "_id"), "_id", "left_anti")), "cross-links"))


def _verified_links(sets: DataFrame) -> DataFrame:
    sizes = written(sets.groupBy("grp").agg(F.count("*").alias("n")), "group-sizes")
    small = sets.join(sizes.where(F.col("n") <= GROUP_DOCS).select("grp"), "grp").groupBy("grp").applyInPandas(_verify, "a long, b long")
    large = sizes.where(F.col("n") > GROUP_DOCS)
    return small.union(_large_links(sets.join(large, "grp"))) if large.limit(1).count() else small


def near_links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """signed(_id, doc, _text, bands, sig), one row for each text with an _id of its own, to links (a, b) of these."""
    groups = candidate_groups(signed)
    wanted = written(groups.join(signed.select("_id", "sig"), "_id"), "candidates")
    texts = docs.select(doc_key().alias("doc"), _text_key().alias("_text"), _words().alias("words"))
    own = signed.select("_id", "doc", "_text").join(wanted, "_id")
    sets = texts.join(own, ["doc", "_text"]).dropDuplicates(["_id"]).select("_id", "grp", "sig", "words").mapInArrow(_sets, "_id long, grp long, sig binary, items binary, weights binary")
    return _verified_links(written(sets, "shingle-sets"))


def _text_key():
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)


def near_classes(docs: DataFrame) -> DataFrame:
    """(_id, _text, class, is_head): for each text of each document the smallest document of its class, and whether it is that one."""
    rows = docs.select(doc_key().alias("_id"), _text_key().alias("_text"), _words().alias("words"))
    signed = written(rows.mapInArrow(_sign, "_id long, _text string, bands array<long>, sig binary"), "signatures")
    # equal texts: one row stands for all; its hashes are the same whichever is taken. Texts are numbered, since one
    # doc_id, or a null one, may have several
    reps = signed.groupBy("_text").agg(F.min("_id").alias("doc"), F.min_by(F.struct("bands", "sig"), "_id").alias("s"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("_id"), "doc", "_text", "s.bands", "s.sig"), "representatives")
    labels = components(near_links(docs, reps))
    linked = written(reps.select("_id", "doc", "_text").join(labels.withColumnRenamed("id", "_id"), "_id"), "linked")
    heads = linked.groupBy("label").agg(F.min(F.struct("doc", "_text")).alias("head"))
    classes = linked.join(heads, "label").select("_text", "head")
    out = signed.select("_id", "_text").join(reps.select("_text", "doc"), "_text").join(classes, "_text", "left")
    head = F.coalesce("head", F.struct("doc", "_text"))
    return out.select("_id", "_text", head["doc"].alias("class"), (F.struct(F.col("_id").alias("doc"), "_text") == head).alias("is_head"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(doc_id_of(F.col("_id")).alias("doc_id"), doc_id_of(F.col("class")).alias("class_id"), F.col("is_head").alias("is_representative"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class, the one with the smallest id, once."""
    stays = near_classes(docs).where("is_head").select("_id", "_text").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), doc_key().alias("_id"), _text_key().alias("_text"))
    return keyed.join(stays, ["_id", "_text"]).dropDuplicates(["_id", "_text"]).select("_doc.*")


#: All pairs of texts that share a shingle, by the similarity itself; equal to the query where the bands miss no pair (3e-6 of those at 0.8). Common shingles
#: are grouped by their two weights, so a pair's sum is over a few groups.
OP4_SQL = """
WITH RECURSIVE rows_ AS (
  SELECT coalesce(doc_id, -9223372036854775808) AS doc, sha256(coalesce(text, '')) AS sha, lower(coalesce(text, '')) AS text FROM documents
), nodes AS (
  SELECT row_number() OVER (ORDER BY min(doc), sha) AS node, min(doc) AS doc, sha, regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0d]+') AS w FROM rows_ GROUP BY sha
), shingles AS (
  SELECT node, s, count(*) AS n FROM (SELECT node, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM nodes WHERE len(w) > 0) GROUP BY ALL
), totals AS (SELECT node, sum(n) AS total FROM shingles GROUP BY node
), common AS (
  SELECT a.node AS a, b.node AS b, a.n AS x, b.n AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.node < b.node GROUP BY ALL
), pairs AS (
  SELECT a, b, list({'x': x, 'y': y, 'c': c}) AS groups, sum(x * c) AS sx, sum(y * c) AS sy FROM common GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN totals ta ON ta.node = a JOIN totals tb ON tb.node = b
  WHERE list_sum(list_transform(groups, lambda i: i.c / ((ta.total - sx) / i.x::DOUBLE + (tb.total - sy) / i.y::DOUBLE + list_sum(list_transform(groups, lambda j: j.c * greatest(j.x / i.x::DOUBLE, j.y / i.y::DOUBLE)))))) >= 0.8
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN ways l ON l.a = r.b
), heads AS (SELECT reach.a AS node, min({'doc': doc, 'sha': sha}) AS head FROM reach JOIN nodes ON nodes.node = reach.b GROUP BY reach.a)
SELECT nullif(r.doc, -9223372036854775808) AS doc_id, nullif(head.doc, -9223372036854775808) AS class_id, r.doc = head.doc AND r.sha = head.sha AS is_representative
FROM rows_ r JOIN nodes USING (sha) JOIN heads USING (node)
"""
