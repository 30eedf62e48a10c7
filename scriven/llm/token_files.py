"""Token-id files, compressed by Re-Pair: frequent pairs of ids become nonterminals, shard by shard.

Documents in ascending id are encoded, each followed by `end_id`, and collected into shards of about
SHARD_IDS ids. A shard's file is one byte string: counts, grammar rules, how many ids each rule stands
for, the documents' ids and extents, then the symbols, 16 bits each and a plane of bits for each further bit. The rule
lengths let `Shard.ids` find and expand any range of a document without the rest. Files are rows of a Parquet table
(part, seq, file), so they are written by Spark's committer and survive a lost executor; (part, seq) is
ascending in document id.

Re-Pair replaces one most frequent pair at a time. Here a round replaces, all at once, every place whose pair is at least as
frequent as the pairs that overlap it on either side; pairs are counted exactly, once at the start and then only
where symbols have changed. Rounds go on until no pair has MIN_COUNT places that do not overlap: at
fewer, a rule costs more than it saves. No pair spans two documents.

Defined cases: null text is empty text, whose only id is end_id; rows of one doc_id stand in order of their
text's hash; a null doc_id comes first; an empty table gives no file and no rows; other columns are not stored; strings of
special tokens in a text are ordinary text (see tokens).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_id_of, doc_key, shuffle_partitions, table, written
from .tokens import encoded_chunks, encoder, gathered

SHARD_IDS, MIN_COUNT = 1 << 20, 4
_MAGIC, _HEAD = b"RPG2", "<4s5I"


def _runs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the pairs by value, number of each one's run of equals in that order)"""
    width, room = max(int(left.max()), int(right.max())).bit_length(), len(left).bit_length()
    key = left.astype(np.uint64) << np.uint64(width) | right
    if 2 * width + room <= 64:
        # value and place in one number: a plain sort is far cheaper than one of places
        both = np.sort(key << np.uint64(room) | np.arange(len(key), dtype=np.uint64))
        order, key = (both & np.uint64((1 << room) - 1)).astype(np.int64), both >> np.uint64(room)
    else:
        order = np.argsort(key)
        key = key[order]
    return order, np.concatenate([[0], np.cumsum(key[1:] != key[:-1], dtype=np.int32)])


def _distinct(places: list[np.ndarray], n: int) -> np.ndarray:
    """Places below n, ascending, each once."""
    every = np.concatenate(places)
    if len(every) > n // 32:
        flag = np.zeros(n + 1, bool)
        flag[every] = True
        return np.flatnonzero(flag[:n]).astype(np.int32)
    every = np.sort(every[every < n])
    return every[np.diff(every, prepend=-1) > 0]


class _Grammar:
    """Symbols as a linked list, so a replacement touches only its neighbours; place n stands before the first and after the last."""

    def __init__(self, symbols: np.ndarray, end_id: int, first_rule: int, least: int):
        self.n, self.end_id, self.next_rule, self.least = len(symbols), end_id, first_rule, least
        self.symbol = np.append(symbols, symbols.dtype.type(end_id)).astype(np.uint32)
        self.after, self.before = np.arange(1, self.n + 2, dtype=np.int32), np.arange(-1, self.n, dtype=np.int32)
        self.after[-1] = self.before[0] = self.n
        #: of each place, the number of the pair that begins there; 0 is no pair, or a rare one
        self.pair, self.count = np.zeros(self.n + 1, np.int32), np.zeros(1, np.int32)
        self.rules: list[np.ndarray] = []
        self._number(np.arange(self.n, dtype=np.int32), symbols, np.append(symbols[1:], symbols.dtype.type(end_id)))

    def _number(self, places: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """New pairs, none of them met before, get numbers if there are enough of them."""
        whole = (left != self.end_id) & (right != self.end_id)
        places, left, right = places[whole], left[whole], right[whole]
        if len(places):
            order, run = _runs(left, right)
            size = np.bincount(run)
            often = size >= self.least
            number = np.zeros(len(size), np.int32)
            number[often] = len(self.count) + np.arange(often.sum(), dtype=np.int32)
            self.pair[places[order]] = number[run]
            self.count = np.concatenate([self.count, size[often].astype(np.int32)])

    def frequent(self) -> np.ndarray:
        return np.flatnonzero(self.count[self.pair] >= self.least).astype(np.int32)

    def best(self, active: np.ndarray) -> np.ndarray:
        """Of the places `active`, those whose pair goes before both pairs that overlap it; every second one of a run of equals."""
        # the more frequent first; equals by a hash of their number, so the same way at each of their places
        rank = self.count.astype(np.int64) << 32 | np.arange(len(self.count), dtype=np.uint32) * np.uint32(0x9E3779B1)
        rank[self.count < self.least] = -1
        own = rank[self.pair[active]]
        live = own >= 0
        active, own = active[live], own[live]
        live = own >= rank[self.pair[self.after[active]]]
        active, own = active[live], own[live]
        return self._apart(active[own >= rank[self.pair[self.before[active]]]])

    def _apart(self, places: np.ndarray) -> np.ndarray:
        """Of places that follow each other every second, from the left."""
        edge = np.ones(len(places), bool)
        edge[1:] = self.after[places[:-1]] != places[1:]
        if edge.all():
            return places
        at = np.arange(len(places))
        return places[(at - np.maximum.accumulate(np.where(edge, at, 0))) % 2 == 0]

    def drop_runs(self) -> None:
        """Pairs of one symbol with itself overlap in runs: those with too few places apart are not frequent."""
        places = self.frequent()
        places = places[self.symbol[places] == self.symbol[self.after[places]]]
        held = np.zeros(len(self.count), bool)
        held[self.pair[places]] = True
        apart = np.bincount(self.pair[self._apart(places)], minlength=len(self.count))
        self.count[held & (apart < self.least)] = 0

    def replace(self, hit: np.ndarray) -> np.ndarray:
        """Each pair at `hit` becomes a rule; the places whose own or neighbouring pairs are new."""
        size, number = len(self.count), self.pair[hit]
        place = np.zeros(size, np.int32)
        place[number] = hit
        used = np.flatnonzero(np.bincount(number, minlength=size))
        name = np.zeros(size, np.uint32)
        name[used] = self.next_rule + np.arange(len(used), dtype=np.uint32)
        self.next_rule += len(used)
        second, before = self.after[hit], self.before[hit]
        third = self.after[second]
        self.rules.append(np.stack([self.symbol[place[used]], self.symbol[self.after[place[used]]]], 1))
        # each of these groups of places holds a pair once: what is taken off is cleared before the next
        for places in (hit, second, before):
            self.count -= np.bincount(self.pair[places], minlength=size).astype(np.int32)
            self.pair[places] = 0
        self.count[0] = 0
        self.symbol[hit], self.symbol[second] = name[number], self.end_id
        self.after[hit], self.before[third] = third, hit
        self.after[self.n] = self.n
        before = self.before[hit]
        new = _distinct([hit, before], self.n)
        self._number(new, self.symbol[new], self.symbol[self.after[new]])
        active = _distinct([new, self.before[before], third], self.n)
        return active[self.pair[active] > 0]

    def symbols(self) -> np.ndarray:
        return self.symbol[:-1][self.before[self.after[:-1]] == np.arange(self.n)]


def compress(symbols: np.ndarray, end_id: int, first_rule: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k, a pair of symbols, is symbol first_rule + k."""
    g = _Grammar(symbols, end_id, first_rule, least or MIN_COUNT)
    active = g.frequent()
    while len(active):
        hit = g.best(active)
        number = g.pair[hit]
        use = (np.bincount(number, minlength=len(g.count)) >= g.least)[number]
        active = g.replace(hit[use]) if use.any() else active[:0]
        if not len(active):
            # all places again: the first of all pairs has enough of them
            g.drop_runs()
            active = g.frequent()
    return g.symbols(), np.concatenate(g.rules) if g.rules else np.zeros((0, 2), np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Top down, for a few symbols: no more than what they stand for is touched."""
    s = symbols.astype(np.uint32)
    while len(s) and (deep := s >= first_rule).any():
        at = np.cumsum(np.where(deep, 2, 1))
        out = np.empty(at[-1], np.uint32)
        out[at[~deep] - 1] = s[~deep]
        pair = rules[s[deep] - first_rule]
        out[at[deep] - 2], out[at[deep] - 1] = pair[:, 0], pair[:, 1]
        s = out
    return s


def expand_all(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, first_rule: int) -> np.ndarray:
    """Bottom up, for a whole shard: each rule is written out once."""
    size = np.concatenate([np.ones(first_rule, np.int64), sizes.astype(np.int64)])
    start = np.cumsum(size) - size
    pool = np.empty(start[-1] + size[-1], np.uint32)
    pool[:first_rule] = np.arange(first_rule)
    depth = np.zeros(len(size), np.int32)
    while True:
        deeper = 1 + np.maximum(depth[rules[:, 0]], depth[rules[:, 1]])
        if (deeper == depth[first_rule:]).all():
            break
        depth[first_rule:] = deeper
    for level in range(1, int(depth.max()) + 1):
        k = np.flatnonzero(depth[first_rule:] == level)
        pair = rules[k].reshape(-1)
        whole = gathered(pool, start[pair], size[pair])
        own, n = start[first_rule + k], size[first_rule + k]
        pool[np.repeat(own - (np.cumsum(n) - n), n) + np.arange(len(whole))] = whole
    return gathered(pool, start[symbols], size[symbols])


def _planes(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)).bit_length() - 16, 0)


def _halves(values: np.ndarray) -> bytes:
    """The low 16 bits of each value, then for each higher bit that is needed a plane of one bit a value."""
    v = values.astype(np.uint32)
    return b"".join([(v & np.uint32(0xFFFF)).astype("<u2").tobytes(), *(np.packbits((v >> np.uint32(16 + p)) & np.uint32(1) > 0, bitorder="little").tobytes() for p in range(_planes(v)))])


class _Halved:
    """Values read from `_halves`, any slice of them."""

    def __init__(self, raw: bytes, at: int, n: int, planes: int):
        self.low = np.frombuffer(raw, "<u2", n, at)
        each = (n + 7) // 8
        self.planes = [np.frombuffer(raw, np.uint8, each, at + 2 * n + p * each) for p in range(planes)]
        self.nbytes = 2 * n + planes * each

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(len(self.low))
        out = self.low[a:b].astype(np.uint32)
        for p, plane in enumerate(self.planes):
            bits = np.unpackbits(plane[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 :][: b - a]
            out |= bits.astype(np.uint32) << np.uint32(16 + p)
        return out


def encode_shard(doc_ids: list[int], ids: list[bytes], dtype, end_id: int, first_rule: int) -> bytes:
    end = np.array([end_id], dtype).tobytes()
    flat = np.frombuffer(b"".join([part for x in ids for part in (x, end)]), dtype)
    lengths = np.array([len(x) for x in ids], np.int64) // np.dtype(dtype).itemsize + 1
    # an id equal to end_id may occur inside a document: the ends are known by length, pairs only avoid the id
    symbols, rules = compress(flat, end_id, first_rule)
    sizes = rule_lengths(rules, first_rule)
    stands = np.where(symbols >= first_rule, sizes[np.maximum(symbols, first_rule) - first_rule] if len(sizes) else 1, 1)
    cuts = np.searchsorted(np.cumsum(stands), np.cumsum(lengths)) + 1
    packed = [rules.reshape(-1), sizes, symbols]
    planes = sum(_planes(v) << 8 * k for k, v in enumerate(packed))
    head = struct.pack(_HEAD, _MAGIC, len(doc_ids), first_rule, len(rules), len(symbols), planes)
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), lengths.astype("<u4").tobytes(), cuts.astype("<u4").tobytes(), *map(_halves, packed)])


def rule_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule stands for; a rule only uses earlier ones, a round at a time."""
    sizes = np.zeros(len(rules), np.int64)
    known = lambda x: np.where(x < first_rule, 1, sizes[np.maximum(x, first_rule) - first_rule])
    while len(rules) and (todo := sizes == 0).any():
        a, b = known(rules[:, 0]), known(rules[:, 1])
        sizes = np.where(todo & (a > 0) & (b > 0), a + b, sizes)
    return sizes


class Shard:
    """A file read back; documents by their place in it."""

    def __init__(self, raw: bytes):
        magic, n, self.first_rule, n_rules, n_symbols, planes = struct.unpack_from(_HEAD, raw)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(_HEAD)
        self.doc_ids = np.frombuffer(raw, "<i8", n, at)
        self.lengths, self.cuts = np.frombuffer(raw, "<u4", n, at + 8 * n), np.frombuffer(raw, "<u4", n, at + 12 * n)
        at, halved = at + 16 * n, []
        for k, count in enumerate((2 * n_rules, n_rules, n_symbols)):
            halved.append(_Halved(raw, at, count, planes >> 8 * k & 255))
            at += halved[-1].nbytes
        self.rules, self.sizes, self.symbols = halved[0][:].reshape(-1, 2), halved[1][:], halved[2]

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[int(self.cuts[k - 1]) if k else 0 : int(self.cuts[k])], self.rules, self.first_rule)

    def ids(self, k: int, start: int, stop: int) -> np.ndarray:
        """ids[start:stop] of document k, expanding only the symbols that hold them."""
        s = self.symbols[int(self.cuts[k - 1]) if k else 0 : int(self.cuts[k])].astype(np.int64)
        sizes = np.where(s >= self.first_rule, self.sizes[np.maximum(s, self.first_rule) - self.first_rule] if len(self.sizes) else 1, 1)
        ends = np.cumsum(sizes)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (ends[a] - sizes[a]) if a < len(s) else 0
        return expand(s[a:b], self.rules, self.first_rule)[skip : skip + stop - start]

    def all_documents(self) -> Iterator[np.ndarray]:
        flat = expand_all(self.symbols[:], self.rules, self.sizes, self.first_rule)
        ends = np.cumsum(self.lengths.astype(np.int64))
        for a, b in zip(ends - self.lengths, ends):
            yield flat[a:b]


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """(part, seq, n_ids, file): the shards, written."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer, False), TaskContext.get().partitionId(), 0
        first_rule = enc.tokenizer.get_vocab_size()
        width = np.dtype(enc.dtype).itemsize
        doc_ids, ids, size = [], [], 0

        def shard():
            n = size // width + len(ids)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": [n], "file": pa.array([encode_shard(doc_ids, ids, enc.dtype, end_id, first_rule)], pa.binary())})

        for batch in batches:
            keys = batch.column("_id").to_pylist()
            for start, encoded in encoded_chunks(enc, batch, "_text"):
                for key, x in zip(keys[start:], encoded):
                    doc_ids.append(key)
                    ids.append(x)
                    size += len(x)
                    if size >= SHARD_IDS * width:
                        yield shard()
                        doc_ids, ids, size, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(doc_key().alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    # the hash parts the texts of one doc_id, such as a null one with a third of all rows
    placed = rows.repartitionByRange(n, "_id", "_hash").sortWithinPartitions("_id", "_hash", "_text").select("_id", "_text")
    return written(placed.mapInArrow(shards, "part int, seq int, n_ids long, file binary"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """(_id, start, n_tokens, ids_crc32) of each document; start counts the ids of all documents before it."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "file")), strict=True):
                shard = Shard(raw)
                n = len(shard.doc_ids)
                ends = np.cumsum(shard.lengths.astype(np.int64))
                crc = [zlib.crc32(x.astype("<u4", copy=False).data) for x in shard.all_documents()]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()), "_id": shard.doc_ids, "inside": ends - shard.lengths, "n_tokens": shard.lengths.astype(np.int64), "ids_crc32": pa.array(crc, pa.int64())})

    # running totals in two steps: over the parts, then over the shards of each part
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all")).select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    starts = sizes.join(parts, "part").select("part", "seq", (F.col("before") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("base"))
    rows = files.select("part", "seq", "file").mapInArrow(documents, "part int, seq int, _id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_files(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_vocabulary())
    return read_files(files).select(doc_id_of(F.col("_id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")
