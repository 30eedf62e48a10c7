"""Exact token ids at word-cache speed: a text is cut where its tokenizer cuts it anyway, pieces are encoded once.

Both vocabularies first split a text by a pattern whose tokens never run from non-space into white space, nor from a
letter or digit into a full stop or comma, and never look back. So encoding can restart before any space or line
end that follows a non-space, and before a stop or comma that follows a letter or digit. Cuts are found in the UTF-8
bytes of many texts at once, wherever the byte before is known to be no white space (or a letter or digit); a place
that is not known is not cut, which is always right. Equal pieces of a batch are encoded once, most of them
from a cache; new ones go through the tokenizers library, plain ones many to a call,
letters alone without the pattern, which would not cut them.

Strings of special tokens inside a text, such as <|endoftext|>, are ordinary text: the vocabularies' own notes set
encode_special_tokens, so a document cannot forge a control id. `specials` of PieceEncoder undoes that.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Distinct pieces kept per Python worker, about 150 bytes each; when they are as many, an eighth goes, those not met for longest.
CACHE_PIECES = 600_000
#: Plain pieces of one call to the library.
_TOGETHER = 256


def _latin(byte: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Whether lead and byte are a Latin letter of two bytes: U+00C0 to U+017F but for two signs, and U+0130, whose lower case ends in a mark."""
    return ((lead == 0xC3) & (byte != 0x97) & (byte != 0xB7)) | ((lead == 0xC4) & (byte != 0xB0)) | (lead == 0xC5)


def cuts(b: np.ndarray) -> np.ndarray:
    """Places of b (UTF-8) where a piece may begin, those at the first byte left out."""
    if len(b) < 2:
        return np.zeros(0, np.int64)
    space = (b == 32) | (b == 10)
    at = np.flatnonzero(space[1:] & (b[:-1] > 32)) + 1
    # after a character of several bytes: no cut if it may be a white space
    wide = b[at - 1] >= 0x80
    if wide.any():
        p = at[wide]
        last, second, third = b[p - 1], b[p - 2], b[np.maximum(p - 3, 0)]
        odd = (second == 0xC2) | ((third == 0xE1) & (second == 0x9A)) | ((third == 0xE2) & ((second == 0x81) | ((second == 0x80) & ((last < 0x8B) | (last > 0xA7))))) | ((third == 0xE3) & (second == 0x80))
        at = np.concatenate([at[~wide], p[~odd]])
    stop = np.flatnonzero(((b[1:-1] == 44) | (b[1:-1] == 46)) & space[2:]) + 1
    before = b[stop - 1]
    word = ((before >= 48) & (before <= 57)) | (((before | 32) >= 97) & ((before | 32) <= 122))
    word |= (before >= 0x80) & (stop > 1) & _latin(before, b[np.maximum(stop - 2, 0)])
    return np.sort(np.concatenate([at, stop[word]]))


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[start : start + size] of each, one after another."""
    end = np.cumsum(size)
    return pool[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


def slices(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[a:e] for a, e in zip(at, at[1:])]


def kinds(data: np.ndarray, offsets: np.ndarray, lower: bool) -> np.ndarray:
    """What a piece is after a space or none: 0 Latin letters alone (lower: small ones), which the vocabulary's own pattern
    does not cut; 1 Latin letters and ASCII signs, which a separator parts safely; 2 anything else."""
    out = np.full(len(offsets) - 1, 2, np.int8)
    wide = np.flatnonzero((data[1:] >= 0x80) & (data[1:] < 0xC0)) + 1
    lead, byte = data[wide - 1], data[wide]
    first, size = offsets[:-1], np.diff(offsets)
    for kind in (1, 0):
        fit = np.zeros(256, bool)
        fit[97:123] = fit[0xC3] = True
        if kind or not lower:
            fit[65:91] = fit[0xC4:0xC6] = True
        if kind:
            fit[33:127] = True
        odd = ~fit[data]
        odd[wide] = ~(_latin(byte, lead) & (kind or not lower or (lead == 0xC3) & (byte >= 0x9F)))
        odd[first[data[first] == 32]] = False
        bad = np.concatenate([[0], np.cumsum(odd)])
        out[(bad[offsets[1:]] == bad[first]) & ((size > 1) | (data[first] != 32))] = kind
    return out


def byte_letters() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible, the others from 256 on."""
    seen = np.zeros(256, bool)
    seen[33:127] = seen[161:173] = seen[174:256] = True
    out = np.arange(256, dtype=np.uint16)
    out[~seen] = 256 + np.arange((~seen).sum())
    return out


class _Known:
    """Pieces and their ids: piece number k has pool[start[k] : start[k] + size[k]]; numbers of pieces that went are given anew."""

    def __init__(self, dtype: np.dtype):
        self.number: dict[bytes, int] = {}
        self.pieces: list[bytes | None] = []
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)
        #: when each piece was last asked for, counted in batches
        self.met, self.now, self.free = np.zeros(0, np.int64), 0, np.zeros(0, np.int64)

    def add(self, pieces: list[bytes], size: np.ndarray, ids: np.ndarray) -> None:
        again, self.free = self.free[: len(pieces)], self.free[len(pieces) :]
        n, more = len(self.start), len(pieces) - len(again)
        at = np.concatenate([again, n + np.arange(more)])
        self.pieces.extend(pieces[len(again) :])
        for k, piece in zip(again.tolist(), pieces):
            self.pieces[k] = piece
        self.number.update(zip(pieces, at.tolist()))
        self.start, self.size, self.met = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.start, self.size, self.met))
        self.start[at], self.size[at], self.met[at] = len(self.pool) + np.cumsum(size) - size, size, self.now
        self.pool = np.concatenate([self.pool, ids])

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """Their numbers, -1 for an unknown one."""
        return np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))

    def make_room(self, new: int) -> None:
        """Pieces not met for longest go, so that `new` more fit; never those of this batch."""
        if len(self.number) + new <= CACHE_PIECES:
            return
        self.met[self.free] = self.now
        old = np.flatnonzero(self.met < self.now)
        least = min(len(old), len(self.number) + new - CACHE_PIECES + CACHE_PIECES // 8)
        gone = old[np.argpartition(self.met[old], least - 1)[:least]] if least else old[:0]
        for k in gone.tolist():
            del self.number[self.pieces[k]]
            self.pieces[k] = None
        self.size[gone], self.free = 0, np.concatenate([self.free, gone])
        self.pool = gathered(self.pool, self.start, self.size)
        self.start = np.cumsum(self.size) - self.size


class PieceEncoder:
    def __init__(self, path: str, drops_space: bool, specials: bool = False):
        """drops_space: the vocabulary lower-cases and gives white space no ids; specials: strings of special tokens are these tokens."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.drops_space, self.specials = drops_space, specials
        # many pieces to a call, parted by a byte that is in none of them and has an id of its own; letters alone without the pattern
        self.words, self.letters, self.mark = Tokenizer.from_file(path), byte_letters(), b"\x01" if drops_space else b"\n"
        self.between = b" \x01 " if drops_space else b"\n"
        self.words.normalizer = None
        self.words.pre_tokenizer = Split(self._lettered(self.mark), "isolated")
        (self.mark_id,) = self.words.encode(self._lettered(self.mark), add_special_tokens=False).ids
        self.known = _Known(self.dtype)

    def _lettered(self, raw: bytes) -> str:
        return self.letters[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le")

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes], kind: int) -> None:
        """Encodes pieces that are not known, all of one of the `kinds`."""
        if kind == 2:
            found = self._ids([p.decode() for p in pieces])
            self.known.add(pieces, np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], self.dtype))
            return
        groups = [pieces[i : i + _TOGETHER] for i in range(0, len(pieces), _TOGETHER)]
        if kind == 1:
            found = self._ids([self.between.join(g).decode() for g in groups])
        else:
            joined = [self.mark.join(map(bytes.lstrip, g) if self.drops_space else g) for g in groups]
            found = [e.ids for e in self.words.encode_batch_fast([self._lettered(x) for x in joined], add_special_tokens=False)]
        flat = np.concatenate([np.array([*ids, self.mark_id], self.dtype) for ids in found])
        stop = flat == self.mark_id
        size = np.diff(np.flatnonzero(stop), prepend=-1) - 1
        if len(size) != len(pieces):
            raise ValueError("the mark's id is not its own")
        self.known.add(pieces, size, flat[~stop])

    def _numbers(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number in self.known of each piece data[offsets[k] : offsets[k + 1]], all of them different."""
        pieces = slices(data, offsets)
        self.known.now += 1
        at = self.known.find(pieces)
        new = np.flatnonzero(at < 0)
        self.known.met[at[at >= 0]] = self.known.now
        if len(new):
            self.known.make_room(len(new))
            kind = kinds(data, offsets, self.drops_space)[new]
            for k in range(3):
                if len(some := new[kind == k]):
                    self._learn([pieces[i] for i in some.tolist()], k)
            at[new] = self.known.find([pieces[i] for i in new.tolist()])
        return at

    def encode_bytes(self, data: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Each text's ids as little-endian integers of self.dtype; texts lie one after another in data (UTF-8), up to `ends`."""
        if self.specials:
            return [np.array(x, self.dtype).tobytes() for x in self._ids([t.decode() for t in slices(data, np.append(0, ends))])]
        if self.drops_space:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), np.where(data == 10, np.uint8(32), data))
        flags = np.zeros(len(data) + 1, bool)
        flags[cuts(data)] = flags[0] = True
        flags[ends] = True
        flags[len(data)] = False
        first = np.flatnonzero(flags[:-1])
        if not len(first):
            return [b""] * len(ends)
        bounds = np.append(first, len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        _, offsets, distinct = coded.dictionary.buffers()
        number = self._numbers(np.frombuffer(distinct, np.uint8), np.frombuffer(offsets, np.int64)[: len(coded.dictionary) + 1])
        which = number[np.asarray(coded.indices)]
        size = self.known.size[which]
        raw = gathered(self.known.pool, self.known.start[which], size).tobytes()
        # ids of each text: those of the pieces that begin before its end
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(first, ends, "left")] * self.dtype.itemsize
        return [raw[a:e] for a, e in zip([0, *upto[:-1].tolist()], upto.tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        return self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw]))


@lru_cache(maxsize=2)
def encoder(path: str, drops_space: bool) -> PieceEncoder:
    """One per Python worker."""
    return PieceEncoder(path, drops_space)


def encoded_chunks(enc: PieceEncoder, batch: pa.RecordBatch, column: str, chunk_bytes: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, ids of the rows) for parts of a batch of about chunk_bytes of text, so memory stays bounded; null is empty."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + chunk_bytes, "right")) - 1)
        yield start, enc.encode_bytes(data[offsets[start] : offsets[stop]], offsets[start + 1 : stop + 1] - offsets[start])
        start = stop
