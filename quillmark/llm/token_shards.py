"""Token ids of a corpus in compressed binary shards, in key order, with random access.

Ids come from a tokenizer file through its library. Each shard is compressed by Re-Pair: frequent pairs of neighbouring
ids are replaced by new symbols, again and again, and the shard stores the rules, the length of each rule's expansion and the remaining
sequence. No rule crosses the end of a document, so each document is decoded on its own from its part of the sequence.

Shard format, all little-endian: ``QTS2``; header of six unsigned 64-bit integers (documents, tokens, rules, symbols of the sequence,
first rule symbol, bytes of a symbol: 2 where all fit, else 4); the ids that occur (u32, as many as the first rule symbol: lower symbols are places in this list); document keys (signed 64-bit) and a byte for each that is 1 where the key is null; tokens of each document (u64); start of each
document in the sequence (u64, one entry more); left and right symbols of the rules; expansion lengths (u64); the sequence.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.llm.common import blocks, drop_stored, large_text, scratch, shared_dir, stored, texts
from quillmark.llm.token_counts import byte_letters

#: Tokens of a shard (a longer document is a shard of its own), most new rules in a round, and how often a pair must occur to become a rule (it wouldn't pay for its rule else).
SHARD, RULES, LEAST = 1 << 20, 16_384, 16
MAGIC = b"QTS2"
#: Bytes encoded at once; bytes of units and their ids that a worker remembers.
_BLOCK, _HELD = 8 << 20, 32 << 20


# ids


#: The pattern and the normalisers of the tokenizer files whose text can be taken apart into units here.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_BREAK, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def _classes() -> np.ndarray:
    """Class of each ASCII byte: breaks are the space and the line feed; odd ones can change how their neighbours are read."""
    kinds = np.full(256, _ODD, np.uint8)
    for c in range(0x21, 0x7F):
        kinds[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _OTHER
    kinds[[0x20, 0x0A]] = _BREAK
    kinds[[0x27, 0x7C]] = _ODD  # the quote of contractions, and the bar of special tokens
    return kinds


_CLASS = _classes().tobytes()
_LOWER = bytes(range(256)).lower()


class LibraryEncoder:
    """Ids by the tokenizers library; each unit of text is encoded once and remembered.

    Where a file's pre-tokenizer drops white space, lowers the case and parts letters, digits and other characters, text is taken apart at spaces and line feeds. A part that holds
    plain characters alone (ASCII and precomposed Latin-1 letters, of which case and composition are certain, without quotes and bars) is taken apart further into
    words, which the library's model encodes; any other part goes to the library whole. Texts of tokenizers of any other kind always go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        normal = spec.get("normalizer") or {}
        split = len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and steps[0]["pattern"].get("Regex") == _PATTERN
        plain = split and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        lowered = [x.get("type") for x in normal.get("normalizers") or []] == _NORMALIZERS and normal["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        marked = all("|" in x["content"] and not re.search(r"\s", x["content"]) for x in spec["added_tokens"])
        self.apart = bool(plain and lowered and marked)
        self.letters = {b: c for b, c in enumerate(byte_letters()) if b != 0x20}
        self._forget()

    def _forget(self) -> None:
        self.known = self.ids = pa.array([], pa.large_binary())

    def whole(self, rows: list[str]) -> list[np.ndarray]:
        """Ids of each text by the library."""
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        out = []
        for low in range(0, len(rows), 2000):
            out += [np.array(e.ids, self.kind) for e in run(rows[low : low + 2000], add_special_tokens=False)]
        return out

    def _learn(self, units: pa.LargeBinaryArray, odd: np.ndarray) -> None:
        """Remembers new units and their ids: of plain words by the library's model, whose alphabet stands for bytes, of other parts by the whole library."""
        raw, flat, count = units.to_pylist(), [], []
        whole = iter(self.whole([raw[k].decode() for k in np.flatnonzero(odd).tolist()]))
        words = b" ".join(raw).decode("latin-1").translate(self.letters).split(" ")
        for word, strange in zip(words, odd.tolist()):
            ids = next(whole).tolist() if strange else [t.id for t in self.tokenizer.model.tokenize(word)]
            flat += ids
            count.append(len(ids))
        self.known = pa.concat_arrays([self.known, units])
        self.ids = pa.concat_arrays([self.ids, _binary(np.concatenate([[0], np.cumsum(count)]), np.array(flat, self.kind))])

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> pa.LargeBinaryArray:
        """Ids of each text ``data[offsets[i]:offsets[i + 1]]`` (UTF-8) and the end id after them."""
        last = np.array(end, self.kind).tobytes()
        if not self.apart:
            each = self.whole([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            return pa.array([x.tobytes() + last for x in each], pa.large_binary())
        units, odd, stop = self._units(data, offsets)
        if self.known.nbytes + self.ids.nbytes > _HELD:
            self._forget()
        slots = pc.index_in(units, value_set=self.known).fill_null(-1).to_numpy()
        new = np.flatnonzero(slots < 0)
        if len(new):
            fresh = units.take(pa.array(new)).dictionary_encode()
            own = fresh.indices.to_numpy()
            slots = slots.copy()
            slots[new] = len(self.known) + own
            strange = np.zeros(len(fresh.dictionary), bool)
            strange[own] = odd[new]
            self._learn(fresh.dictionary, strange)
        ids = pa.concat_arrays([self.ids, pa.array([last], pa.large_binary())])
        taken = ids.take(pa.array(np.insert(slots, stop, len(self.ids))))
        _, places, values = taken.buffers()
        places = np.frombuffer(places, np.int64)[np.concatenate([[0], stop + np.arange(1, len(offsets))])]
        return pa.Array.from_buffers(pa.large_binary(), len(stop), [None, pa.py_buffer(places), values])

    @staticmethod
    def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
        """The units without the breaks between them, plain ones lower-cased, which of them are parts that aren't plain, and how many there are up to the end of each text."""
        n = len(data)
        raw = bytearray(data)
        low = raw.translate(_LOWER)
        kind, line = np.frombuffer(raw.translate(_CLASS), np.uint8), np.frombuffer(low, np.uint8)
        lead = np.flatnonzero(data[:-1] == 0xC3)  # the lead byte of Latin-1 letters
        second = data[lead + 1]
        lead = lead[(second != 0x97) & (second != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        line[lead[data[lead + 1] <= 0x9E] + 1] += 0x20
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        first, inside = first[:n], kind != _BREAK
        odd = kind == _ODD
        odd[1:] &= (kind[:-1] != _ODD) | first[1:]
        odd = np.flatnonzero(odd)
        if len(odd):  # a part with an odd byte is odd as a whole and stays as it is
            part = inside.copy()
            part[1:] &= ~inside[:-1] | first[1:]
            stops = np.append(np.flatnonzero(part | ~inside), n)
            at = np.unique(np.searchsorted(stops, odd, side="right"))
            begin, size = stops[at - 1], stops[at] - stops[at - 1]
            own = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
            kind[own], line[own] = _ODD, data[own]
        mark = first | (kind == _DIGIT)
        mark[1:] |= kind[1:] != kind[:-1]
        mark &= inside
        begin = np.flatnonzero(mark)
        odd, stop = kind[begin] == _ODD, np.searchsorted(begin, offsets[1:])
        line = np.frombuffer(low.translate(None, b" \n"), np.uint8)
        return _binary(np.append(np.flatnonzero(mark[inside]), len(line)), line), odd, stop


def _binary(places: np.ndarray, values: np.ndarray) -> pa.LargeBinaryArray:
    """Rows of bytes: row i holds ``values[places[i]:places[i + 1]]``."""
    return pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64) * values.itemsize), pa.py_buffer(values)])


@functools.cache
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _gathered(batches):
    """Neighbouring batches together, up to _BLOCK bytes: what is remembered is looked through once for each block, however short the texts are."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > _BLOCK:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def _encode(path: str, end: int):
    def run(batches):
        use = encoder(path)
        for batch in _gathered(batches):
            data, offsets = large_text(batch.column(1))
            for low, high in blocks(offsets, _BLOCK):
                at = offsets[low : high + 1]
                out = use.encode(data[at[0] : at[-1]], at - at[0], end).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), out], ["doc_id", "ids"])

    return run


# Re-Pair


def repair(sequence: np.ndarray, barrier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Compresses ids; no pair reaches over an index in ``barrier`` (a boolean array: the last symbol of a document).

    Each round counts pairs, makes a rule of each of the most frequent ones and replaces them left to right without overlap, until no pair occurs LEAST times. A pair of known symbols never
    becomes more frequent, so that after the first round only places of frequent pairs and of new symbols are counted. Returns the remaining sequence, its barriers,
    the left and right symbols of the rules, the expansion length of every symbol, and the first rule symbol.
    """
    first = int(sequence.max()) + 1 if len(sequence) else 0
    sequence, length, left, right = sequence.astype(np.uint32), np.ones(first, np.uint64), [], []
    last, ask, new = 1, 2, 4  # flags of each symbol: its document ends, its pair with the next one may be frequent, it is new
    flag = np.where(barrier, last, ask).astype(np.uint8)
    flag[-1:] = last
    while True:
        at = np.flatnonzero((flag & (last | ask)) == ask)
        pair, place = _grouped(sequence, at, len(length))
        edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else at
        count = np.diff(np.append(edge, len(pair)))
        often = count >= LEAST
        rules = np.flatnonzero(often)
        if not len(rules):
            break
        if len(rules) > RULES:
            rules = np.sort(rules[np.argsort(-count[rules], kind="stable")[:RULES]])
        symbol = np.zeros(len(sequence), np.uint32)
        flag &= last
        flag[place[np.repeat(often, count)]] |= ask
        taken = np.zeros(len(count), bool)
        taken[rules] = True
        symbol[place[np.repeat(taken, count)]] = np.repeat(np.arange(len(length), len(length) + len(rules), dtype=np.uint32), count[rules])
        at = np.flatnonzero(symbol != 0)
        run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) & 1 == 0]
        one, two = sequence[place[edge[rules]]], sequence[place[edge[rules]] + 1]
        left.append(one)
        right.append(two)
        length = np.concatenate([length, length[one] + length[two]])
        sequence[at] = symbol[at]
        flag[at] = (flag[at + 1] & last) | ask | new
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        sequence, flag = sequence[keep], flag[keep]
        at = np.flatnonzero((flag & new) != 0)
        flag[at[at > 0] - 1] |= ask
    join = lambda x: np.concatenate(x).astype("<u4") if x else np.zeros(0, "<u4")
    return sequence, (flag & last).astype(bool), join(left), join(right), length, first


def _grouped(sequence: np.ndarray, at: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for the pair at each place of ``at``, and the places, equal pairs together and each pair's places in order."""
    wide, room = np.uint64(max(1, (symbols - 1).bit_length())), np.uint64(len(sequence).bit_length())
    pair = (sequence[at].astype(np.uint64) << wide) | sequence[at + 1]
    if 2 * wide + room > 64:  # places don't fit beside their pairs
        order = np.argsort(pair, kind="stable")
        return pair[order], at[order]
    both = (pair << room) | at.astype(np.uint64)
    both.sort()
    return both >> room, (both & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)


def expand(sequence: np.ndarray, left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    """The ids that a part of a sequence stands for."""
    while len(sequence) and (rule := sequence >= first).any():
        width = 1 + rule.astype(np.int64)
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), sequence.dtype)
        out[at[~rule]] = sequence[~rule]
        out[at[rule]] = left[sequence[rule] - first]
        out[at[rule] + 1] = right[sequence[rule] - first]
        sequence = out
    return sequence


def pack(keys: list[int | None], documents: list[np.ndarray]) -> bytes:
    """A shard of documents."""
    count = np.array([len(d) for d in documents], "<u8")
    flat = np.concatenate(documents).astype(np.int64) if documents else np.zeros(0, np.int64)
    alphabet = np.flatnonzero(np.bincount(flat))
    place = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 0, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    flat = place[flat]
    barrier = np.zeros(len(flat), bool)
    filled = np.cumsum(count)[count > 0].astype(np.int64)
    barrier[filled - 1] = True
    sequence, ends, left, right, length, first = repair(flat, barrier)
    stop = np.zeros(len(count) + 1, "<u8")
    own = np.zeros(len(count), np.int64)
    own[count > 0] = np.flatnonzero(ends) + 1
    stop[1:] = np.maximum.accumulate(own)
    null = np.array([k is None for k in keys], np.uint8)
    ids = np.array([0 if k is None else k for k in keys], "<i8")
    wide = 2 if first + len(left) <= 1 << 16 else 4
    head = struct.pack("<6Q", len(documents), len(flat), len(left), len(sequence), first, wide)
    symbols = [x.astype(f"<u{wide}").tobytes() for x in (left, right, sequence)]
    return b"".join([MAGIC, head, alphabet.astype("<u4").tobytes(), ids.tobytes(), null.tobytes(), count.tobytes(), stop.tobytes(), *symbols[:2], length[first:].astype("<u8").tobytes(), symbols[2]])


class Shard:
    """A shard opened for reading; only the documents asked for are expanded."""

    def __init__(self, blob: bytes):
        if bytes(blob[:4]) != MAGIC:
            raise ValueError("this is no token shard")
        n, self.tokens, rules, symbols, self.first, wide = struct.unpack("<6Q", blob[4:52])
        at, kind = 52, f"<u{wide}"

        def take(kind, size):
            nonlocal at
            out = np.frombuffer(blob, kind, size, at)
            at += out.nbytes
            return out

        self.alphabet = take("<u4", self.first)
        self.keys, self.null, self.count, self.stop = take("<i8", n), take("u1", n), take("<u8", n), take("<u8", n + 1)
        self.left, self.right, self.length, self.sequence = take(kind, rules), take(kind, rules), take("<u8", rules), take(kind, symbols)

    def __len__(self) -> int:
        return len(self.keys)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        return self.alphabet[expand(self.sequence[int(self.stop[i]) : int(self.stop[i + 1])], self.left, self.right, self.first)]

    def every(self) -> np.ndarray:
        """Ids of all documents, end to end."""
        rules = expand(np.arange(self.first, self.first + len(self.left), dtype=np.uint32), self.left, self.right, self.first)
        places = np.concatenate([np.arange(self.first + 1), self.first + np.cumsum(self.length).astype(np.int64)])
        each = _binary(places, self.alphabet[np.concatenate([np.arange(self.first), rules])])
        return np.frombuffer(each.take(pa.array(self.sequence.astype(np.uint32))).buffers()[2] or b"", "<u4")[: self.tokens]

    def token(self, i: int, k: int) -> int:
        """The k-th id of the i-th document: a search in the summed expansion lengths, then one way down the rules."""
        part = self.sequence[int(self.stop[i]) : int(self.stop[i + 1])]
        wide = np.ones(len(part), np.int64)
        wide[part >= self.first] = self.length[part[part >= self.first] - self.first]
        ends = np.cumsum(wide)
        at = int(np.searchsorted(ends, k, side="right"))
        symbol, k = int(part[at]), k - int(ends[at] - wide[at])
        while symbol >= self.first:
            one, two = int(self.left[symbol - self.first]), int(self.right[symbol - self.first])
            size = 1 if one < self.first else int(self.length[one - self.first])
            symbol, k = (one, k) if k < size else (two, k - size)
        return int(self.alphabet[symbol])


def _write(batches, kind: str):
    part, shard, before = TaskContext.get().partitionId(), 0, 0
    keys, rows, size = [], [], 0

    def row():
        nonlocal shard, before, keys, rows, size
        blob = pack(keys, rows)
        out = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([shard]), pa.array([before]), pa.array([size]), pa.array([len(rows)]), pa.array([blob], pa.binary())], ["part", "shard", "before", "n_tokens", "n_docs", "blob"])
        shard, before, keys, rows, size = shard + 1, before + size, [], [], 0
        return out

    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(ids.as_buffer(), kind)
            if size and size + len(own) > SHARD:
                yield row()
            keys.append(key)
            rows.append(own.copy())
            size += len(own)
    if rows:
        yield row()


_SHARD = "part long, shard long, before long, n_tokens long, n_docs long, blob binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encodes ``docs`` and writes shards below ``path`` in ascending key order (null first; equal keys by their ids).

    Null and empty texts hold the end id alone. The writer is Spark's, so that a failed or repeated task leaves no half-written shard.
    """
    spark = docs.sparkSession
    ids = stored(texts(docs, key, text).mapInArrow(_encode(tokenizer, end), "doc_id long, ids binary"), "ids")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    kind = encoder(tokenizer).kind
    ordered.mapInArrow(lambda batches: _write(batches, kind), _SHARD).write.option("compression", "zstd").parquet(path)
    drop_stored(ids)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards; ``start`` counts the ids of all documents before it.

    Tokens of the write's partitions, one row for each, are summed to find where each partition begins; ids never leave their task.
    """

    def run(batches):
        for batch in batches:
            for blob, base in zip(batch.column(0), batch.column(1).to_pylist()):
                shard = Shard(blob.as_buffer())
                ends = np.cumsum(shard.count).astype(np.int64)
                ids, start = memoryview(shard.every().tobytes()), ends - shard.count.astype(np.int64)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(start.tolist(), ends.tolist())]
                start = base + start
                keys = pa.array(shard.keys, mask=shard.null.astype(bool))
                yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(shard.count.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(_SHARD).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    begins = totals.select("part", (F.sum("own").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("own")).alias("begin"))
    placed = shards.join(begins, "part").select("blob", (F.col("begin") + F.col("before")).alias("base"))
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer: str, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes shards to a new path below the shared folder and reads them back; see ``write_shards`` and ``read_shards``."""
    path = scratch(docs.sparkSession, "token-shards")
    write_shards(docs, path, tokenizer, end, key, text)
    return read_shards(docs.sparkSession, path)


__all__ = ["LibraryEncoder", "Shard", "expand", "pack", "read_shards", "repair", "shared_dir", "token_shards", "write_shards"]
