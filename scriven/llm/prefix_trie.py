"""Prefix trie of conversations: which turns many conversations begin with, and what a shared prefix saves.

A turn (role, text) is known by its SHA-256 and gets a number in a dictionary; a conversation becomes an array of numbers, and
conversations that are wholly equal become one sequence with its members. The trie is built by radix partitioning from the
first turn on: all sequences of a bucket share a prefix; one aggregate finds how far the prefix reaches (the common
beginning of the bucket's least and greatest sequence), the nodes on that stretch are emitted, and the bucket is dealt out by the next
number. Buckets of up to `LOCAL` turns are local: many of them share a task, where multikey quicksort orders a bucket's
sequences and its recursion opens a node for each run of equal numbers. Totals over subtrees flow back from local buckets up the levels.

Memory: a task holds one local bucket at a time. A bucket with few distinct sequences is small whatever its number of conversations.
Two things are one value by nature and must fit into a row: a conversation's array of turns, and the list of those conversations that end
in one node. A number that a large share of turns or sequences holds is joined by broadcast of at most a thousand keys.

Defined cases: null role or text is empty; null turns come first, rows of one turn stand in order of the SHA-256 of (role, text); repeated rows
are turns of their own; a null conv_id is a conversation that keeps its own turns, is smaller than all others and has an empty decimal
form; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, doc_id_of, doc_key, keyed_join, table, written

#: A bucket of up to so many turns, and sequences, is finished in one task.
LOCAL = 8192
NODE = "conv long, depth long, parent long, n long, children long, leaves long, saved long, ends string"
#: What a local bucket's first node tells its parent: level and number of the parent's bucket.
TOP = "level int, above long"
NO_ONE = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of the empty string


def sequences(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) to (conv, turns): array of (id, bytes) in order, ids by the dictionary."""
    c, s = F.col, lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    same = F.unhex(F.sha2(F.concat_ws("\n", F.octet_length(s("role")).cast("string"), s("role"), s("text")), 256))
    rows = written(turns.select(doc_key("conv_id").alias("conv"), c("turn").cast("long").alias("turn"), same.alias("sha"), F.octet_length(s("text")).alias("bytes")), "turns")
    found = rows.groupBy("sha").agg(F.count("*").alias("held"))
    dictionary = written(found.select("sha", "held", F.monotonically_increasing_id().alias("id")), "dictionary")
    coded = keyed_join(rows, dictionary, ["sha"], "held")
    whole = coded.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "sha", "id", "bytes"))).alias("t"))
    return written(whole.select("conv", F.transform("t", lambda x: F.struct(x.id.alias("id"), x.bytes.alias("bytes"))).alias("turns")), "conversations")


def rebuilt(whole: DataFrame) -> DataFrame:
    """Each conversation with its first crc32(conv) % 9 turns taken from conversation conv - conv % 5."""
    c, null = F.col, F.col("conv") == NULL_ID
    heads = whole.where((c("conv") % 5 == 0) & ~null).select(c("conv").alias("base"), F.slice("turns", 1, 8).alias("head"))
    h = F.when(null, 0).otherwise((F.crc32(c("conv").cast("string").cast("binary")) % 9).cast("int"))
    rows = whole.select("conv", "turns", h.alias("h"), (c("conv") - c("conv") % 5).alias("base")).join(heads, "base", "left")
    head = F.coalesce(c("head"), F.slice("turns", 1, 0))
    return rows.select("conv", F.concat(F.slice(head, F.lit(1), c("h")), F.slice("turns", c("h") + 1, F.size("turns"))).alias("turns"))


def distinct_sequences(whole: DataFrame) -> DataFrame:
    """(conv, turns) to one row a distinct sequence: ids, sizes, conv (the least), n, ends (digest of all its conversations)."""
    decimal = F.transform(F.sort_array(F.collect_list("conv")), lambda x: F.when(x == NULL_ID, "").otherwise(x.cast("string")))
    one = whole.groupBy("turns").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.sha2(F.array_join(decimal, ","), 256).alias("ends"))
    return one.select(F.col("turns.id").alias("ids"), F.col("turns.bytes").alias("sizes"), "conv", "n", "ends")


def finish(seqs: list[list[int]], sizes: list[list[int]], convs: list[int], ns: list[int], ends: list[str], depth: int, above: int | None, top: int) -> list[list]:
    """The nodes of one bucket, first its top, as rows of NODE: multikey quicksort whose every step into equal numbers opens a node.

    seqs start behind the top; depth is the top's, above its parent's conversation, top the bytes of its last text.
    """
    nodes, parents, bytes_of = [], [], []

    def opened(members, d, parent, size):
        ended = [m for m in members if len(seqs[m]) == d]
        nodes.append([min(convs[m] for m in members), depth + d, above if parent is None else nodes[parent][0], sum(ns[m] for m in members), 0, 0, 0, ends[ended[0]] if ended else NO_ONE])
        parents.append(parent)
        bytes_of.append(size)
        if parent is not None:
            nodes[parent][4] += 1
        return [m for m in members if len(seqs[m]) > d] if ended else members

    todo = [(opened(range(len(seqs)), 0, None, top), 0, 0)]
    while todo:
        members, d, node = todo.pop()
        if not members:
            continue
        a, b, c = (seqs[members[i]][d] for i in (0, len(members) // 2, -1))
        pivot = max(min(a, b), min(max(a, b), c))
        equal = [m for m in members if seqs[m][d] == pivot]
        if len(equal) < len(members):
            todo.append(([m for m in members if seqs[m][d] < pivot], d, node))
            todo.append(([m for m in members if seqs[m][d] > pivot], d, node))
        rest = opened(equal, d + 1, node, sizes[equal[0]][d])
        todo.append((rest, d + 1, len(nodes) - 1))
    for i in range(len(nodes) - 1, -1, -1):  # parents come before their children
        x = nodes[i]
        x[5] += x[4] == 0
        x[6] += (x[3] - 1) * bytes_of[i]
        if parents[i] is not None:
            nodes[parents[i]][5] += x[5]
            nodes[parents[i]][6] += x[6]
    return nodes


def _finished(members: DataFrame) -> DataFrame:
    """Nodes of all local buckets; members are rows of (level, bucket, above_bucket, depth, above, top, ids, sizes, conv, n, ends)."""
    schema = pa.schema([*[(x, pa.int64()) for x in ("conv", "depth", "parent", "n", "children", "leaves", "saved")], ("ends", pa.string()), ("level", pa.int32()), ("above", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, out = None, [], []

        def close():
            for i, x in enumerate(finish(*([r[k] for r in own] for k in ("ids", "sizes", "conv", "n", "ends")), own[0]["depth"], own[0]["above"], own[0]["top"])):
                out.append((*x, key[0] if i == 0 else None, own[0]["above_bucket"] if i == 0 else None))

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema, strict=True)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                if (row["level"], row["bucket"]) != key:
                    if own:
                        close()
                        if len(out) > 20_000:
                            yield made()
                    key, own = (row["level"], row["bucket"]), []
                own.append(row)
        if own:
            close()
        if out:
            yield made()

    keys = ["level", "bucket"]
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, f"{NODE}, {TOP}")


def _too_large(local: int) -> Column:
    return (F.col("held") > 1) & (F.col("held") + F.col("total") > local)


def trie(seqs: DataFrame, local: int = LOCAL) -> DataFrame:
    """Rows of `distinct_sequences` (a written table) to the nodes of their trie: NODE."""
    c = F.col
    size = F.size("ids").cast("long")
    held, total = seqs.agg(F.count("*"), F.sum(size)).first()
    if not held:
        return seqs.sparkSession.createDataFrame([], NODE)
    none = F.lit(None).cast("long")
    rest = lambda: [F.slice("ids", c("depth") + 1, F.size("ids")).alias("ids"), F.slice("sizes", c("depth") + 1, F.size("sizes")).alias("sizes")]
    start = seqs.select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("bucket"), none.alias("above_bucket"), F.lit(0).alias("depth"), none.alias("above"), F.lit(0).cast("long").alias("top"), "ids", "sizes", "conv", "n", "ends")
    if not (held > 1 and held + total > local):
        return _finished(start).select(*[x.split()[0] for x in NODE.split(", ")])
    locals_, levels, big = [], [], start.withColumn("held", F.lit(held)).withColumn("total", F.lit(total))
    while True:
        level = len(levels)
        # how far each bucket's common prefix reaches, and its members dealt by the number behind it
        first = F.array_position(F.zip_with(F.min("ids"), F.max("ids"), lambda x, y: F.coalesce(x == y, F.lit(False))), False) - 1
        ones = {x: F.any_value(x).alias(x) for x in ("depth", "above", "above_bucket", "held", "top")}
        buckets = big.groupBy("bucket").agg(first.cast("int").alias("reach"), F.min_by("sizes", "ids").alias("sizes"), F.min("conv").alias("conv"), F.sum("n").alias("n"), *ones.values())
        buckets = written(buckets.withColumn("sizes", F.slice("sizes", c("depth") + 1, c("reach") - c("depth"))), "buckets")
        reach = buckets.select("bucket", "reach", c("conv").alias("lead"), "held")
        dealt = keyed_join(big.drop("held"), reach, ["bucket"], "held").withColumn("next", F.coalesce(F.get("ids", "reach"), F.lit(-1)))
        dealt = written(dealt.drop("held", "total"), "dealt")
        parts = dealt.groupBy("bucket", "next").agg(F.count("*").alias("held"), F.sum(size - c("reach") - 1).alias("total"), F.max("ends").alias("ends"))
        parts = written(parts.withColumn("part", F.monotonically_increasing_id()), "parts")
        about = parts.groupBy("bucket").agg(F.count_if(c("next") >= 0).alias("children"), F.max(F.when(c("next") < 0, c("ends"))).alias("ends"))
        levels.append(buckets.drop("held").join(about, "bucket"))
        below = keyed_join(dealt.where("next >= 0").withColumnRenamed("bucket", "above_"), parts.where("next >= 0").select(c("bucket").alias("above_"), "next", "part", "held", "total"), ["above_", "next"], "held")
        below = below.select(F.lit(level + 1).alias("level"), c("part").alias("bucket"), c("above_").alias("above_bucket"), (c("reach") + 1).alias("depth"), c("lead").alias("above"), F.get("sizes", "reach").cast("long").alias("top"), "ids", "sizes", "conv", "n", "ends", "held", "total")
        below = written(below, "level")
        locals_.append(below.where(~_too_large(local)).select("level", "bucket", "above_bucket", "depth", "above", "top", *rest(), "conv", "n", "ends"))
        big = below.where(_too_large(local))
        if not big.limit(1).count():
            break
    members = locals_[0]
    for more in locals_[1:]:
        members = members.unionByName(more)
    done = written(_finished(members), "nodes")
    names = [x.split()[0] for x in NODE.split(", ")]
    tops, nodes = done.where("level is not null").select("level", F.col("above").alias("bucket"), "leaves", "saved"), done.select(*names)
    for level in range(len(levels) - 1, -1, -1):
        sums = tops.where(c("level") == level + 1).groupBy("bucket").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"))
        at = levels[level].join(sums, "bucket")
        # the stretch of the common prefix: one node a depth, saved_tokens summed from its end
        own = (c("n") - 1) * F.aggregate("sizes", c("top"), lambda s, x: s + x)
        tops = tops.union(at.select(F.lit(level), "above_bucket", "leaves", (c("below") + own).alias("saved")))
        stretch = at.select("*", F.posexplode(F.concat(F.array("top"), c("sizes").cast("array<long>"))).alias("i", "bytes"), F.size("sizes").alias("last"))
        upward = Window.partitionBy("bucket").orderBy(c("i").desc())
        end = c("i") == c("last")
        nodes = nodes.union(
            stretch.select(
                "conv", (c("depth") + c("i")).cast("long"), F.when(c("i") == 0, c("above")).otherwise(c("conv")), "n", F.when(end, c("children")).otherwise(F.lit(1)).cast("long"),
                "leaves", c("below") + (c("n") - 1) * F.sum("bytes").over(upward), F.when(end, F.coalesce("ends", F.lit(NO_ONE))).otherwise(F.lit(NO_ONE)),
            )
        )
    return nodes


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = rebuilt(sequences(table(spark, sf_dir, "conversations")))
    nodes, c = trie(written(distinct_sequences(whole), "sequences")), F.col
    return nodes.select(doc_id_of(c("conv")).alias("conv_id"), "depth", doc_id_of(c("parent")).alias("parent_conv_id"), c("n").alias("n_convs"), c("children").alias("n_children"), c("leaves").alias("n_leaves"), c("saved").alias("saved_tokens"), c("ends").alias("ends_sha256"))


#: Nodes as groups of equal prefix lists; a node's ancestors are the nodes that its smallest member is in at lesser depths.
OP13_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b) ORDER BY b) AS t
  FROM range(256) r(b)
), turns AS (
  SELECT coalesce(conv_id, -9223372036854775808) AS conv, turn, coalesce(text, '') AS text,
         sha256(strlen(coalesce(role, '')) || chr(10) || coalesce(role, '') || chr(10) || coalesce(text, '')) AS sha FROM conversations
), numbered AS (
  SELECT conv, sha, strlen(text) AS bytes, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, sha) AS pos FROM turns
), convs AS (
  SELECT conv, CASE WHEN conv > -9223372036854775808 THEN conv - conv % 5 END AS base, CASE WHEN conv > -9223372036854775808 THEN
         xor(list_reduce(list_transform(range(length(conv::VARCHAR)), lambda i: unicode((conv::VARCHAR)[i + 1])::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 9 ELSE 0 END AS h
  FROM (SELECT DISTINCT conv FROM turns), crc_table
), parts AS (
  SELECT c.conv, 0 AS part, n.pos, n.sha, n.bytes FROM convs c JOIN numbered n ON n.conv = c.base AND n.pos <= c.h
  UNION ALL SELECT c.conv, 1, n.pos, n.sha, n.bytes FROM convs c JOIN numbered n ON n.conv = c.conv AND n.pos > c.h
), prefixes AS (
  SELECT conv, bytes, row_number() OVER w AS d, list(sha) OVER w AS prefix FROM parts WINDOW w AS (PARTITION BY conv ORDER BY part, pos)
  UNION ALL SELECT conv, 0, 0, [] FROM convs
), lengths AS (SELECT conv, max(d) AS len FROM prefixes GROUP BY conv
), members AS (
  SELECT conv, d, bytes, len, min(conv) OVER (PARTITION BY prefix) AS lead FROM prefixes JOIN lengths USING (conv)
), nodes AS (
  SELECT lead, d, count(*) AS n, (count(*) - 1) * max(bytes) AS own,
         sha256(coalesce(string_agg(CASE WHEN conv > -9223372036854775808 THEN conv::VARCHAR ELSE '' END, ',' ORDER BY conv) FILTER (WHERE len = d), '')) AS ends
  FROM members GROUP BY lead, d
), parented AS (
  SELECT n.*, m.lead AS parent FROM nodes n LEFT JOIN members m ON m.conv = n.lead AND m.d = n.d - 1
), children AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM parented WHERE parent IS NOT NULL GROUP BY ALL
), full_ AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM parented p LEFT JOIN children c ON c.parent = p.lead AND c.d = p.d
), sums AS (
  SELECT m.lead, m.d, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum(f.own)::BIGINT AS saved
  FROM full_ f JOIN members m ON m.conv = f.lead AND m.d <= f.d GROUP BY ALL
)
SELECT nullif(lead, -9223372036854775808) AS conv_id, d AS depth, nullif(parent, -9223372036854775808) AS parent_conv_id, n AS n_convs,
       n_children, n_leaves, saved AS saved_tokens, ends AS ends_sha256
FROM full_ JOIN sums USING (lead, d)
"""
