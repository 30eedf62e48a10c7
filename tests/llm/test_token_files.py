import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scriven.llm import token_files as T
from scriven.llm.tokens import PieceEncoder, encoded_chunks

TEXTS = ["", " ", "\n", "a  b", " lead", "tail \n", "don't we'll 12,345\n\n  x", "tab\there  nbsp wide", "\x1cfs\x1c !", "éá ñ ß", "<|endoftext|> it", "word " * 300, "x" * 5000]
SIGNS = ["a", "B", " ", "'", "s", "\n", "\t", "!", ".", ",", "1", "é", "É", "×", "÷", "ş", "ж", "  ", "  ", " ", "　\n", " ", "  ", "\u0085", "\x1d", "\x01", "́", "” ", "İ", "中", "\U0001f600"]


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@pytest.mark.parametrize("specials", [False, True])
def test_pieces_give_the_ids_of_whole_texts(name, drops, specials):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(SIGNS) for _ in range(60)) for _ in range(1500)] + ["a.b c, d. e,\nf .\n, <|startoftext|> x"]
    enc = PieceEncoder(public_tokenizers.path(name), drops, specials)
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = not specials
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # anew, then from the cache
        assert [list(np.frombuffer(b, enc.dtype)) for b in enc.encode(texts)] == want


def test_special_strings_are_text_unless_asked_for():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = [np.frombuffer(PieceEncoder(path, False, s).encode(["<|endoftext|>"])[0], np.uint16).tolist() for s in (False, True)]
    assert len(ids[0]) > 1 and ids[1] == [50256]


def test_chunks_of_a_sliced_batch_with_nulls():
    enc = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), False)
    texts = ["skipped", None, "one two", "", None, "three, four. five", "x"]
    batch = pa.RecordBatch.from_pydict({"t": texts}).slice(1)
    got = [x for _, xs in encoded_chunks(enc, batch, "t", 8) for x in xs]
    assert got == enc.encode([t or "" for t in texts[1:]])
    assert list(encoded_chunks(enc, batch.slice(0, 0), "t")) == []


def test_cache_starts_again_and_stays_right(monkeypatch):
    monkeypatch.setattr("scriven.llm.tokens.CACHE_PIECES", 20)
    enc = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), True)
    texts = [" ".join(f"w{i * j % 37}x" for j in range(9)) for i in range(40)]
    assert [list(np.frombuffer(enc.encode([t])[0], enc.dtype)) for t in texts] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    docs = [np.concatenate([rng.integers(0, 40, n), np.tile(rng.integers(0, 9, 7), 30)]).astype(np.uint16) for n in (0, 5, 3000, 900)] + [np.zeros(0, np.uint16), np.full(501, 7, np.uint16), np.array([3, 0, 0, 3, 0] * 60, np.uint16)]
    raw = T.encode_shard(list(range(len(docs))), [d.tobytes() for d in docs], np.uint16, 0, 50)
    shard = T.Shard(raw)
    assert len(shard.symbols[:]) < 0.75 * sum(map(len, docs))
    for k, (want, got) in enumerate(zip(docs, shard.all_documents(), strict=True)):
        want = np.append(want, 0)
        assert (got == want).all() and (shard.document(k) == want).all() and len(got) == len(want)
        for a, b in ((0, 1), (len(want) // 3, 2 * len(want) // 3), (0, len(want))):
            assert (shard.ids(k, a, b) == want[a:b]).all()


@pytest.mark.parametrize("first_rule", [60, 70_000])
def test_more_than_sixteen_bits(first_rule):
    rng = np.random.default_rng(5)
    flat = rng.integers(1, first_rule, 300).astype(np.uint32)[rng.integers(0, 300, 6000)]
    raw = T.encode_shard([4, 9], [flat[:2500].tobytes(), flat[2500:].tobytes()], np.uint32, 0, first_rule)
    a, b = T.Shard(raw).all_documents()
    assert (a[:-1] == flat[:2500]).all() and (b[:-1] == flat[2500:]).all()


def _places(s, end_id, pair):
    """How often a pair occurs without overlap, from the left."""
    n = i = 0
    while i < len(s) - 1:
        hit = (s[i], s[i + 1]) == pair
        n, i = n + hit, i + 1 + hit
    return n


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(7)
    for case in range(30):
        s = rng.integers(0, rng.integers(2, 12), rng.integers(2, 900)).astype(np.uint16)
        if case % 3 == 0:
            s = np.repeat(s, rng.integers(1, 9, len(s)))
        symbols, rules = T.compress(s, 0, 20)
        assert (T.expand(symbols, rules, 20) == s).all()
        left = list(symbols)
        for pair in set(zip(left, left[1:])):
            assert 0 in pair or _places(left, 0, pair) < T.MIN_COUNT
        assert not len(rules) or not (rules == 0).any()


def test_rounds_go_on_while_pairs_are_frequent():
    s = np.tile(np.arange(1, 65, dtype=np.uint32), 4096)
    symbols, rules = T.compress(s, 0, 100)
    assert len(symbols) < 32 and (T.expand(symbols, rules, 100) == s).all()
    assert (T.expand_all(symbols, rules, T.rule_lengths(rules, 100), 100) == s).all()


def test_query_matches_direct_encoding(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SHARD_IDS", 500)
    rows = [(i * 3 - 5, t) for i, t in enumerate(TEXTS)] + [(None, "none"), (1000, None)]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, file string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in T.op9_token_files(spark, str(tmp_path)).collect()}
    tok = Tokenizer.from_file(T.byte_vocabulary())
    tok.encode_special_tokens = True
    start = 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_repeated_ids_and_rows_each_have_their_place(spark, tmp_path):
    rows = [(None, f"nameless {i % 40}") for i in range(120)] + [(7, t) for t in ("a b", "a b", "c", None, "")] + [(9, "end")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = T.op9_token_files(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(T.byte_vocabulary())
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == sorted((-1 if i is None else i, crc(t)) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None] * 120 + [7] * 5 + [9]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert T.op9_token_files(spark, str(tmp_path)).count() == 0


def test_pieces_are_learned_once_while_there_is_room(monkeypatch):
    monkeypatch.setattr("scriven.llm.tokens.CACHE_PIECES", 1000)
    enc, learned = PieceEncoder(T.byte_vocabulary(), False), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda pieces, kind: learned.extend(pieces) or learn(pieces, kind))
    letters = "abcdefghij"
    word = lambda k: " x" + "".join(letters[int(x)] for x in str(k))
    batches = [["".join(map(word, range(100 * k, 100 * k + 100)))] for k in range(8)]
    first = [enc.encode(b) for b in batches]
    assert [enc.encode(b) for _ in range(2) for b in batches] == first * 2 and len(learned) == len(set(learned))
    # more than there is room for: the oldest go, the ids stay right
    wide = [["".join(map(word, range(100 * k, 100 * k + 100)))] for k in range(30)]
    ids = [enc.encode(b) for b in wide + wide]
    assert ids[:8] == first and ids[30:] == ids[:30] and len(enc.known.number) <= 1000
    plain = PieceEncoder(T.byte_vocabulary(), False).tokenizer
    assert [list(np.frombuffer(b[0], enc.dtype)) for b in ids[:30]] == [plain.encode(b[0], add_special_tokens=False).ids for b in wide]
