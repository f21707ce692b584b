"""Token ids in files coded by a static range asymmetric numeral system (rANS).

A file holds the ids of many documents in order. One frequency table, counted over the whole file, is
shared by its blocks. A block is coded by itself: LANES interleaved states step through it together,
so coding is array arithmetic. The directory is the list of checkpoints: each block's place, size,
number of ids, final states and checksums, so readers decode any blocks side by side.

Layout: MAGIC, blocks, then zlib-packed sections (table: symbols and frequencies; documents: ids,
their validity and lengths; directory), then the tail: three section offsets, the number of ids, a crc32 of the sections.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"RANSIDS1"
LANES, BLOCK, BITS = 1024, 1 << 18, 20
_LOW = np.uint64(1 << 32)
_TAIL = struct.Struct("<QQQQQI8s")
_ENTRY = np.dtype([("at", "<u8"), ("size", "<u8"), ("first", "<u8"), ("n", "<u4"), ("coded_crc", "<u4"), ("ids_crc", "<u4")])


@dataclass
class Table:
    """Frequencies of symbols, summing to 1 << BITS. slots: the symbol's place for each of the sum's values."""

    symbols: np.ndarray
    freq: np.ndarray

    def __post_init__(self) -> None:
        self.start = np.cumsum(self.freq) - self.freq
        self.place = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 0, np.int32)
        self.place[self.symbols] = np.arange(len(self.symbols), dtype=np.int32)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freq.astype(np.int64))


def count_table(ids: np.ndarray) -> Table:
    """A table over the ids that occur: proportional, at least 1 each, the rest given to the largest."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(counts)
    n = counts[symbols]
    total = 1 << BITS
    if len(symbols) > total:
        raise ValueError(f"more than {total} different ids in one file")
    freq = np.maximum(1, (n * ((total - len(symbols)) / max(1, n.sum()))).astype(np.int64))
    order = np.argsort(-freq, kind="stable")
    left = total - int(freq.sum())
    for k in order if len(symbols) else []:
        step = max(left, 1 - int(freq[k]))
        freq[k] += step
        left -= step
        if not left:
            break
    return Table(symbols.astype(np.uint32), freq.astype(np.uint64))


def code_block(table: Table, ids: np.ndarray) -> bytes:
    """Final states of the lanes, then 32-bit words in the order in which a reader takes them."""
    place = table.place[ids]
    freq, start = table.freq[place], table.start[place]
    lanes = min(LANES, len(ids))
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    for row in range((len(ids) - 1) // lanes, -1, -1):
        f, c = freq[row * lanes : (row + 1) * lanes], start[row * lanes : (row + 1) * lanes]
        x = state[: len(f)]
        full = x >= (f << np.uint64(64 - BITS))
        if len(table.symbols) == 1:
            full = np.zeros(len(f), bool)
        if full.any():
            words.append(x[full].astype(np.uint32))
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(f)] = (q << np.uint64(BITS)) + (x - q * f) + c if len(table.symbols) > 1 else x
    return state.tobytes() + (np.concatenate(words[::-1]).tobytes() if words else b"")


def decode_block(table: Table, slots: np.ndarray, data: bytes, n: int) -> np.ndarray:
    lanes = min(LANES, n)
    if len(table.symbols) == 1:
        return np.full(n, table.symbols[0], np.uint32)
    state = np.frombuffer(data, np.uint64, lanes).copy()
    words = np.frombuffer(data, np.uint32, offset=8 * lanes)
    mask, at, out = np.uint64((1 << BITS) - 1), 0, np.empty(n, np.int32)
    for row in range((n - 1) // lanes + 1):
        x = state[: min(lanes, n - row * lanes)]
        low = x & mask
        place = slots[low]
        out[row * lanes : row * lanes + len(x)] = place
        x = table.freq[place] * (x >> np.uint64(BITS)) + low - table.start[place]
        short = x < _LOW
        k = int(short.sum())
        if k:
            x[short] = (x[short] << np.uint64(32)) | words[at : at + k]
            at += k
        state[: len(x)] = x
    return table.symbols[out]


def pack(doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """A file's parts. ids: of all its documents, one after another."""
    table = count_table(ids)
    parts, at, entries = [MAGIC], len(MAGIC), []
    for first in range(0, len(ids), BLOCK):
        own = ids[first : first + BLOCK].astype(np.uint32)
        coded = code_block(table, own)
        entries.append((at, len(coded), first, len(own), zlib.crc32(coded), zlib.crc32(own.tobytes())))
        parts.append(coded)
        at += len(coded)
    docs = struct.pack("<Q", len(doc_ids)) + doc_ids.astype("<i8").tobytes() + valid.astype("u1").tobytes() + lengths.astype("<u8").tobytes()
    packed_table = struct.pack("<Q", len(table.symbols)) + table.symbols.astype("<u4").tobytes() + table.freq.astype("<u4").tobytes()
    places, crc = [], 0
    for section in (packed_table, docs, np.array(entries, _ENTRY).tobytes()):
        packed = zlib.compress(section, 1)
        crc = zlib.crc32(packed, crc)
        places.append(at)
        parts.append(packed)
        at += len(packed)
    return [*parts, _TAIL.pack(*places, at, len(ids), crc, MAGIC)]


class Reader:
    """A file by ranges: get(place, size) gives its bytes, a negative place counting from the end."""

    def __init__(self, get) -> None:
        self.get = get
        a, b, c, end, self.n, crc, magic = _TAIL.unpack(get(-_TAIL.size, _TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of coded ids")
        data = get(a, end - a)
        if zlib.crc32(data) != crc:
            raise ValueError("damaged sections")
        raw = zlib.decompress(data[: b - a])
        (k,) = struct.unpack_from("<Q", raw)
        self.table = Table(np.frombuffer(raw, "<u4", k, 8), np.frombuffer(raw, "<u4", k, 8 + 4 * k).astype(np.uint64))
        raw = zlib.decompress(data[b - a : c - a])
        (k,) = struct.unpack_from("<Q", raw)
        self.doc_ids = np.frombuffer(raw, "<i8", k, 8)
        self.valid = np.frombuffer(raw, "u1", k, 8 + 8 * k).astype(bool)
        self.lengths = np.frombuffer(raw, "<u8", k, 8 + 9 * k).astype(np.int64)
        self.directory = np.frombuffer(zlib.decompress(data[c - a :]), _ENTRY)
        self._slots: np.ndarray | None = None

    def block(self, k: int) -> np.ndarray:
        """The ids of block k, checked."""
        e = self.directory[k]
        data = self.get(int(e["at"]), int(e["size"]))
        if zlib.crc32(data) != e["coded_crc"]:
            raise ValueError(f"block {k} is damaged")
        if self._slots is None:
            self._slots = self.table.slots()
        ids = decode_block(self.table, self._slots, data, int(e["n"]))
        if zlib.crc32(ids.tobytes()) != e["ids_crc"]:
            raise ValueError(f"block {k} decodes to other ids")
        return ids
