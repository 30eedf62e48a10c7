"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards.

Equal vectors of one label are one point with a count. Points of a label are cut into cluster shards: a shard of over `CAP` points gets centres
from a bounded sample of its points and each point goes to its nearest centres, so shards overlap; this repeats until all
are small. In each shard a graph is built and pruned robustly, the adjacency lists of a point's shards are united, and every
point is searched from the medoid of each of its shards; from what is within the range the search goes on to all neighbours. A
point found in a shard where the query has not been is a reason to search that query in all of that point's shards too, round by round, until there is no new shard.
Links are verified in double precision. A pair that shares shards counts in the first of them alone, so no pair is written: a task returns
counts, and for components one edge a point.

Recall is audited: up to `AUDITED` points of rows whose id is divisible by 50 are compared with all points, and if fewer than `RECALL` of their links were
found the whole is repeated with more centres a point.

What grows with a group: n_links counts each of the pairs of a group of unlike near copies, so a group of g different vectors costs g^2
comparisons, spread over its shards; searches sent to a shard are dealt over tasks of `CAP` queries. Exact copies cost nothing.

Defined cases: a null label, and vectors that are null, empty, zero or hold null, NaN or infinity link with nothing; vectors of different
lengths do not link; every row is a vector of its own, so rows repeated or sharing an id link with each other; a null
vec_id is smaller than all others and is returned as null; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph_shard as G
from .common import NULL_ID, doc_id_of, doc_key, keyed_join, table, written
from .components import components

LEAST = 0.93
#: Points of a shard at most, and searches of other shards' points in one task.
CAP = 2048
#: Centres of a shard that is cut, and points sampled to fit them.
CENTRES, SAMPLE = 64, 2048
#: A point goes to centres whose cosine is so little below the best, two at least and `HOMES` at most (widths tried in turn by the audit).
MARGIN = 0.05
HOMES = (3, 6, 12)
AUDITED, RECALL = 256, 0.97


def _unit(v: list | np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that large components do not overflow."""
    x = np.asarray(v, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(column: pa.Array) -> np.ndarray:
    """An Arrow list column whose rows are equally long, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def by_key(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """work on all rows of each key: many small keys share a task, which holds one key's rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def done():
            got = work(pa.Table.from_batches(held))
            held.clear()
            return [got] if got is not None and got.num_rows else []

        for batch in batches:
            values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            starts = [i for i in range(len(values)) if i == 0 or values[i] != values[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(values)]):
                if held and values[lo] != last:
                    yield from done()
                last = values[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _list(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def points(vectors: DataFrame) -> DataFrame:
    """vectors(key, embedding, label) to one row a label and different vector: node, group, label, embedding, held (rows), low (smallest key)."""
    c = F.col
    usable = vectors.where(_usable())
    found = usable.groupBy("label", "embedding").agg(F.count("*").alias("held"), F.min("key").alias("low"), F.max((c("key") % 50 == 0) & (c("key") != NULL_ID)).alias("asked"))
    one = written(found.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "points")
    groups = written(one.groupBy("label", "dim").agg(F.count("*").alias("size")).withColumn("group", F.monotonically_increasing_id()), "groups")
    return written(keyed_join(one, groups, ["label", "dim"], "size"), "grouped")


def _usable():
    """Vectors that can link: all components finite, one of them not zero, and a label."""
    v, c = F.col("embedding"), F.col
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(c("label").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _fitted(pool: pa.Table) -> pa.RecordBatch:
    """Centres of one shard's sample: spherical k-means from its first points."""
    x = _unit(_rows(pool["embedding"].combine_chunks()))
    k = min(len(x), int(pool["k"][0].as_py()))
    centres = x[:k]
    for _ in range(6):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return pa.RecordBatch.from_arrays([pa.array([pool["shard"][0].as_py()]), pa.array([int(pool["size"][0].as_py())]), pa.array([x.shape[1]], pa.int32()), _list([centres.ravel()], pa.float64())], names=["shard", "size", "dim", "centres"])


def _dealt(homes: int):
    """Points behind their shard's centres to the shards below: the nearest for one that is a copy already, more for the first of a point's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = None
        for batch in batches:
            shard, deal = batch.column("shard").to_pylist(), batch.column("deal").to_pylist()
            starts = [i for i in range(len(shard)) if i == 0 or (shard[i], deal[i]) != (shard[i - 1], deal[i - 1])]
            take, names, mains = [], [], []
            for lo, hi in zip(starts, [*starts[1:], len(shard)]):
                if batch.column("centres")[lo].is_valid:
                    centres = np.asarray(batch.column("centres")[lo].values).reshape(-1, batch.column("dim")[lo].as_py())
                    lo += 1
                if lo == hi:
                    continue
                main = batch.column("main").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                cos = _unit(_rows(batch.column("embedding").slice(lo, hi - lo))) @ centres.T
                best = np.argsort(-cos, axis=1)[:, :homes]
                near = np.take_along_axis(cos, best, 1)
                goes = near >= near[:, :1] - MARGIN
                goes[:, :2] = True
                goes[:, 1:] &= main[:, None]
                i, j = np.nonzero(goes)
                take.append(lo + i)
                names += [f"{shard[lo]}/{x}" for x in best[i, j]]
                mains.append(main[i] & (j == 0))
            if take:
                out = batch.select(["node", "embedding"]).take(pa.array(np.concatenate(take)))
                yield pa.RecordBatch.from_arrays([pa.array(names), *out.columns, pa.array(np.concatenate(mains))], names=["shard", "node", "embedding", "main"])

    return work


def shards(found: DataFrame, homes: int = HOMES[0], cap: int = CAP) -> DataFrame:
    """Points to (shard, node, embedding), a row for each shard that a point is in; shards overlap and hold up to cap points."""
    c = F.col
    kind = dict(found.dtypes)["embedding"]
    members = found.select(c("group").cast("string").alias("shard"), "node", "embedding", F.lit(True).alias("main"))
    kept = None
    while True:
        sizes = written(members.groupBy("shard").agg(F.count("*").alias("size")), "sizes")
        large = sizes.where(c("size") > cap)
        small = members.join(large.select("shard"), "shard", "left_anti").select("shard", "node", "embedding")
        kept = small if kept is None else kept.unionByName(small)
        if not large.limit(1).count():
            return written(kept, "members")
        # a sample of each large shard, by hash: SAMPLE points are expected
        rest = keyed_join(members, large, ["shard"], "size")
        share = F.pmod(F.xxhash64("node", F.lit(17)), F.lit(1 << 30)) / float(1 << 30) * c("size")
        k = F.least(F.lit(CENTRES), F.greatest(F.lit(12), F.ceil(c("size") * 6 / cap))).cast("int")
        pool = rest.where(share < SAMPLE).select("shard", "size", k.alias("k"), "embedding", F.xxhash64("node").alias("at"))
        centres = by_key(pool, ["shard"], ["at"], _fitted, "shard string, size long, dim int, centres array<double>")
        # a large shard is dealt over tasks, each of which meets the centres first
        deals = F.ceil(c("size") / (8 * cap)).cast("int")
        first = centres.withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("size")
        rest = rest.withColumn("deal", F.pmod(F.xxhash64("node", F.lit(5)), deals).cast("int")).drop("size")
        both = rest.unionByName(first, allowMissingColumns=True).withColumn("last", c("centres").isNull())
        both = both.repartition("shard", "deal").sortWithinPartitions("shard", "deal", "last")
        members = written(both.mapInArrow(_dealt(homes), f"shard string, node long, embedding {kind}, main boolean"), "dealt")


def _built(shard: pa.Table) -> pa.RecordBatch:
    """Adjacency of one shard, as nodes."""
    node = shard["node"].to_numpy()
    x = _unit(_rows(shard["embedding"].combine_chunks())).astype(np.float32)
    graph = G.built(x)[: len(x)]
    return pa.RecordBatch.from_arrays([pa.array(node), _list([node[g[g < len(x)]] for g in graph], pa.int64())], names=["node", "out"])


class _Shard:
    """The points of one shard and the united edges between them, ready for searches."""

    def __init__(self, t: pa.Table):
        self.node, self.held = t["node"].to_numpy(), t["held"].to_numpy()
        self.homes = [np.asarray(h) for h in t["homes"].to_pylist()]
        self.exact = _unit(_rows(t["embedding"].combine_chunks()))
        self.x = self.exact.astype(np.float32)
        n, place = len(self.node), {int(v): i for i, v in enumerate(self.node)}
        own = [[place[v] for v in out if v in place] for out in t["out"].to_pylist()]
        self.graph = np.full((n + 1, max(1, *map(len, own))), n, np.int64)
        for i, v in enumerate(own):
            self.graph[i, : len(v)] = v
        self.ways, self.medoid = G.both_ways(self.graph), G.medoid(self.x)
        all_homes = sorted({h for hs in self.homes for h in hs.tolist()})
        self.bit = {h: i for i, h in enumerate(all_homes)}
        self.names = np.array(all_homes)
        self.lives = np.zeros((n, len(all_homes)), bool)
        for i, h in enumerate(self.homes):
            self.lives[i, [self.bit[v] for v in h.tolist()]] = True

    def found(self, exact: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) within the range; own: the queries' places where they are points of this shard."""
        q, v = [], []
        for lo in range(0, len(exact), G.block(self.x)):
            hi = min(len(exact), lo + G.block(self.x))
            entries = np.full((hi - lo, 1), self.medoid)
            entries = entries if own is None else np.column_stack([entries, own[lo:hi]])
            a, b = G.in_range(self.x, self.exact, self.graph, self.ways, exact[lo:hi], entries, LEAST)
            q.append(a + lo)
            v.append(b)
        return np.concatenate(q), np.concatenate(v)

    def known(self, homes: list[list[int]]) -> np.ndarray:
        """Which of this shard's home shards each query is or was searched in."""
        out = np.zeros((len(homes), len(self.names)), bool)
        for i, h in enumerate(homes):
            out[i, [self.bit[x] for x in h if x in self.bit]] = True
        return out


FOUND = "node long, links long, near long, fresh array<long>"


def _least_linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes to (node, the smallest node that it is linked to over any number of links)."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _result(s: _Shard, shard: int, nodes: np.ndarray, q: np.ndarray, v: np.ndarray, known: np.ndarray, now: np.ndarray) -> pa.RecordBatch:
    """One row a query: links that count here, and shards of what was found where the query has not been; one row a linked node: the smallest of its component.

    known: shards that the query was or is searched in; now: those of this round. A pair counts in the first shard of the first round that it meets in.
    """
    links, new = np.zeros(len(nodes), np.int64), np.zeros(known.shape, bool)
    for lo in range(0, len(q), G.PAIRS // 8):
        a, b = q[lo : lo + G.PAIRS // 8], v[lo : lo + G.PAIRS // 8]
        before = (s.lives[b] & (known & ~now)[a]).any(1)
        counts = ~before & (np.argmax(s.lives[b] & now[a], axis=1) == s.bit[shard])
        np.add.at(links, a[counts], s.held[b[counts]])
        np.logical_or.at(new, a, s.lives[b])
    new &= ~known
    linked_, least = _least_linked(nodes[q], s.node[v])
    none = [None] * len(linked_)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([nodes, linked_])), pa.array([*links.tolist(), *none], pa.int64()), pa.array([*[None] * len(nodes), *least.tolist()], pa.int64()), _list([*[s.names[x] for x in new], *none], pa.int64())],
        names=["node", "links", "near", "fresh"],
    )


def _searched_home(t: pa.Table) -> pa.RecordBatch:
    """Every point of a shard searched in it; a link that one side finds holds for both."""
    s = _Shard(t)
    q, v = s.found(s.exact, np.arange(len(s.node)))
    key = np.unique(np.concatenate([q * len(s.node) + v, v * len(s.node) + q]))
    q, v = key // len(s.node), key % len(s.node)
    q, v = q[q != v], v[q != v]
    return _result(s, int(t["shard"][0].as_py()), s.node.copy(), q, v, s.lives, s.lives)


def _searched_away(t: pa.Table) -> pa.RecordBatch | None:
    """Searches sent to a shard: its points come first, then the queries with where they were searched and are in this round."""
    asked = np.array(t["tried"].is_valid().to_pylist(), bool)
    points_, queries = t.filter(pa.array(~asked)), t.filter(pa.array(asked))
    if not queries.num_rows:
        return None
    s = _Shard(points_)
    exact = _unit(_rows(queries["embedding"].combine_chunks()))
    q, v = s.found(exact, None)
    tried, now = s.known(queries["tried"].to_pylist()), s.known(queries["now"].to_pylist())
    return _result(s, int(t["shard"][0].as_py()), queries["node"].to_numpy(), q, v, tried | now, now)


def linked(found: DataFrame, homes: int = HOMES[0], cap: int = CAP) -> DataFrame:
    """Points to (node, links, label_): rows linked to a point other than its own, and the smallest node of its component."""
    c = F.col
    members = shards(found, homes, cap)
    names = written(members.select("shard").distinct().select("shard", F.monotonically_increasing_id().alias("id")), "shards")
    members = written(members.join(names, "shard").select(c("id").alias("shard"), "node", "embedding"), "numbered")
    out = written(by_key(members, ["shard"], ["node"], _built, "node long, out array<long>"), "edges")
    united = out.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out"))
    where = members.groupBy("node").agg(F.sort_array(F.collect_list("shard")).alias("homes"))
    full = members.join(united, "node").join(where, "node").join(found.select("node", "held"), "node")
    full = written(full.select("shard", "node", "embedding", "held", "out", "homes"), "graph")
    parts = [written(by_key(full, ["shard"], ["node"], _searched_home, FOUND), "found")]
    state = full.groupBy("node").agg(F.first("homes").alias("tried"))
    while True:
        more = parts[-1].where(F.size("fresh") > 0).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("fresh"))).alias("now"))
        more = written(more.join(state, "node").select("node", "tried", F.array_except("now", "tried").alias("now")).where(F.size("now") > 0), "more")
        if not more.limit(1).count():
            break
        state = more.select("node", F.array_union("tried", "now").alias("tried")).unionByName(state.join(more.select("node"), "node", "left_anti"))
        queries = more.join(found.select("node", "embedding"), "node").select(F.explode("now").alias("shard"), "node", "embedding", "tried", "now")
        # many searches of one shard are dealt over tasks, each with the shard's points
        queries = written(queries, "queries")
        asked = written(queries.groupBy("shard").agg(F.count("*").alias("asked")), "asked")
        deals = F.ceil(c("asked") / cap).cast("int")
        queries = keyed_join(queries, asked, ["shard"], "asked").withColumn("deal", F.pmod(F.xxhash64("node"), deals).cast("int")).drop("asked")
        there = full.join(asked, "shard").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("asked")
        both = there.unionByName(queries, allowMissingColumns=True)
        parts.append(written(by_key(both, ["shard", "deal"], ["node"], _searched_away, FOUND), "found"))
        state = written(state, "tried")
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)
    links = everything.groupBy("node").agg(F.sum("links").alias("links"))
    edges = everything.where("near < node").select(c("node").alias("a"), c("near").alias("b"))
    labels = components(edges)
    return written(links.join(labels.withColumnRenamed("id", "node"), "node", "left").select("node", "links", F.coalesce("label", "node").alias("label_")), "linked")


def audited(found: DataFrame, links: DataFrame, sample: int = AUDITED) -> float:
    """Share of the true links that were found, over up to sample points with a row whose id is divisible by 50, each against all points."""
    asked = found.where("asked").orderBy(F.xxhash64("node")).limit(sample).join(links, "node").select("node", "group", "embedding", "links").collect()
    if not asked:
        return 1.0
    by_group: dict[int, tuple[list, np.ndarray]] = {}
    for r in asked:
        by_group.setdefault(r["group"], ([], None))[0].append(r)
    by_group = {g: (rows, _unit([r["embedding"] for r in rows])) for g, (rows, _) in by_group.items()}

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, node, held = (batch.column(k).to_numpy() for k in ("group", "node", "held"))
            true = 0
            for g in np.intersect1d(group, list(by_group)):
                at = np.nonzero(group == g)[0]
                rows, x = by_group[g]
                near = _unit(_rows(batch.column("embedding").take(pa.array(at)))) @ x.T >= LEAST
                near &= node[at][:, None] != np.array([r["node"] for r in rows])
                true += int((near * held[at][:, None]).sum())
            yield pa.RecordBatch.from_arrays([pa.array([true])], names=["true"])

    true = found.select("group", "node", "held", "embedding").mapInArrow(compared, "true long").agg(F.sum("true")).first()[0] or 0
    return sum(r["links"] for r in asked) / true if true else 1.0


def near_duplicates(vectors: DataFrame, cap: int = CAP) -> DataFrame:
    """vectors(vec_id, embedding, label) to one row a vector: key, n_links, component (keys are ids, null as the smallest)."""
    c = F.col
    vectors = vectors.select(doc_key("vec_id").alias("key"), "embedding", "label")
    found = points(vectors)
    for homes in HOMES:
        links = linked(found, homes, cap)
        if audited(found, links) >= RECALL:
            break
    whole = written(found.join(links, "node").select("label", "embedding", "held", "low", c("links") + c("held") - 1, c("label_").alias("top")).toDF("label", "embedding", "held", "low", "n_links", "top"), "whole")
    tops = written(whole.groupBy("top").agg(F.min("low").alias("component"), F.count("*").alias("size")), "tops")
    known = written(keyed_join(whole.select("label", "embedding", "held", "n_links", "top"), tops, ["top"], "size").select("label", "embedding", "held", "n_links", "component"), "known")
    out = keyed_join(vectors.where(_usable()), known, ["label", "embedding"], "held").select("key", "n_links", "component")
    return out.unionByName(vectors.where(~_usable()).select("key", F.lit(0).cast("long").alias("n_links"), c("key").alias("component")))


def op11_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, c = near_duplicates(table(spark, sf_dir, "embeddings")), F.col
    return out.select(doc_id_of(c("key")).alias("vec_id"), "n_links", doc_id_of(c("component")).alias("component_id"), (c("key") == c("component")).alias("kept"))


#: All pairs of a label; equal to the query where the index finds every link, as it does on the small tables.
OP11_SQL = """
WITH RECURSIVE numbered AS (
  SELECT row_number() OVER () AS rn, coalesce(vec_id, -9223372036854775808) AS key, label, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
  SELECT * FROM numbered WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.rn AS a, b.rn AS b FROM usable a JOIN usable b ON a.label = b.label AND a.rn <> b.rn AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT rn AS a, rn AS b FROM numbered
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), found AS (
  SELECT reach.a AS rn, min(key) AS component FROM reach JOIN numbered ON numbered.rn = reach.b GROUP BY reach.a
), degrees AS (SELECT a AS rn, count(*) AS n_links FROM links GROUP BY a)
SELECT nullif(key, -9223372036854775808) AS vec_id, coalesce(n_links, 0) AS n_links, nullif(component, -9223372036854775808) AS component_id, key = component AS kept
FROM numbered JOIN found USING (rn) LEFT JOIN degrees USING (rn)
"""
