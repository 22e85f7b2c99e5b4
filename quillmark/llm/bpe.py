"""Byte-level BPE over rank files: encoding and decoding of whole texts.

A pre-token is first sought in a minimal perfect hash of the vocabulary, which resolves it with one probe and one
comparison. Other pre-tokens start as a linked list of bytes; a heap yields the adjacent pair of the lowest
rank, leftmost first, until no pair is in the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from quillmark.llm.common import per_batch, texts, worker_store

#: Most words in each generation of a worker's memory.
MEMORY = 120_000
_ALL, _STEP, _SPREAD = 0xFFFFFFFFFFFFFFFF, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys onto 0..n-1, by hash and displacement."""

    def __init__(self, keys: list[bytes], seed: int = 0):
        self.n, self.seed = len(keys), seed
        self.buckets = max(1, self.n // 4)
        while not self._build(keys):
            self.seed += 1

    def _build(self, keys) -> bool:
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k, self.seed) for k in keys), ">u8").astype(np.uint64).reshape(-1, 2)
        if len(np.unique(digest, axis=0)) < self.n:
            return False
        n, low = np.uint64(max(self.n, 1)), digest[:, 1]
        home = (digest[:, 0] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        size = np.bincount(home, minlength=self.buckets)
        start = np.concatenate([[0], np.cumsum(size)])
        taken, move = np.zeros(self.n, bool), np.zeros(self.buckets, np.int64)
        self.slot_of = np.zeros(self.n, np.int64)
        tries = np.arange(256, dtype=np.uint64)
        for b in np.argsort(-size, kind="stable"):
            own = order[start[b] : start[b + 1]]
            if len(own) < 2:
                break
            for base in range(0, 1 << 20, 256):
                moved = low[own] + (tries + np.uint64(base))[:, None] * np.uint64(_STEP)
                moved = (moved ^ (moved >> np.uint64(32))) * np.uint64(_SPREAD)
                at = ((moved ^ (moved >> np.uint64(29))) % n).astype(np.int64)
                fits = ~taken[at].any(axis=1)
                spread = np.sort(at, axis=1)
                fits &= (spread[:, 1:] != spread[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(np.argmax(fits))
                    taken[at[k]] = True
                    self.slot_of[own], move[b] = at[k], base + k
                    break
            else:
                return False
        free = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(size == 1):  # a single key takes any free slot, named directly
            slot = next(free)
            self.slot_of[order[start[b]]], move[b] = slot, -1 - slot
        self.move = move.tolist()
        return True

    def slot(self, key: bytes) -> int:
        """The slot of ``key`` if it is a key; any slot otherwise."""
        digest = xxhash.xxh3_128_intdigest(key, self.seed)
        high, low = digest >> 64, digest & _ALL
        move = self.move[high % self.buckets]
        if move < 0:
            return -1 - move
        moved = (low + move * _STEP) & _ALL
        moved = ((moved ^ (moved >> 32)) * _SPREAD) & _ALL
        return (moved ^ (moved >> 29)) % self.n


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merging linked bytes through a heap."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [ranks.get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]
    heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
    heapq.heapify(heap)
    get, pop, push = ranks.get, heapq.heappop, heapq.heappush
    while heap:
        rank, i = divmod(pop(heap), n)
        if pair[i] != rank:
            continue
        gone = after[i]
        after[i] = end = after[gone]
        pair[gone] = -1
        if end < n:
            before[end] = i
            pair[i] = r = get(piece[i : after[end]], -1)
            if r >= 0:
                push(heap, r * n + i)
        else:
            pair[i] = -1
        left = before[i]
        if left >= 0:
            pair[left] = r = get(piece[left:end], -1)
            if r >= 0:
                push(heap, r * n + left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Memory(dict):
    """A bounded dict that computes what it lacks: when full, what is still in use is taken over one by one."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        keys = list(self.ranks)
        self.hash = PerfectHash(keys)
        self.keys: list[bytes] = [b""] * len(keys)
        self.ids = [0] * len(keys)
        for k, slot in zip(keys, self.hash.slot_of.tolist()):
            self.keys[slot], self.ids[slot] = k, self.ranks[k]
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for k, i in self.ranks.items():
            self.bytes_of[i] = k
        space = r"\p{White_Space}"
        self.find = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", space)).findall
        self.uneven = regex.compile(f"{space} {space}").search
        self.pieces, self.first, self.rest = Memory(self._piece), Memory(self._text), Memory(lambda p: self._text(" " + p))

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        slot = self.hash.slot(raw)
        ids = [self.ids[slot]] if self.keys[slot] == raw else merged(raw, self.ranks)
        return np.array(ids, "<u4").tobytes()

    def _text(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A space after or before another character than white space always begins a pre-token, so the parts between spaces are encoded
        on their own, unless a space has white space on both sides. Parts of over 200 characters aren't remembered.
        """
        if self.uneven(text):
            return self._text(text)
        parts = text.split(" ")
        if len(text) > 200 * len(parts) and max(map(len, parts)) > 200:
            return self._text(text) if len(parts) == 1 else b"".join([self._text(parts[0]), *(self._text(" " + p) if len(p) > 200 else self.rest[p] for p in parts[1:])])
        rest = self.rest
        return b"".join([self.first[parts[0]], *map(rest.__getitem__, parts[1:])])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once in each worker."""
    store = worker_store("bpe")
    if (path, pattern) not in store:
        store[path, pattern] = Codec(path, pattern)
    return store[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids of every text as little-endian unsigned 32-bit integers, and the bytes that they decode to.

    Null and empty texts have no ids. Each row of ``docs`` has its row, whatever its key.
    """

    def make(batch):
        use = codec(path, pattern)
        ids = [use.encode(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(use.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return texts(docs, key, text).mapInArrow(per_batch(make), "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text: ``encoded`` without moving ids and bytes out of the worker."""

    def make(batch):
        use = codec(path, pattern)
        count, ids_hash, decoded_hash = [], [], []
        for t in batch.column(1).to_pylist():
            ids = use.encode(t)
            count.append(len(ids) // 4)
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            decoded_hash.append(hashlib.sha256(use.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, key, text).mapInArrow(per_batch(make), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
