"""Benchmark decontamination by suffix arrays of the training texts.

Texts are read as words. A shard of texts (about a megabyte) gets a suffix array: the suffixes that begin in runs of words in which every two neighbours stand together in the
benchmark too, sorted by prefix doubling over whole runs; from any other place no match of a window's length can begin. Every suffix of every benchmark item that holds a window is sought
in it by binary search, which gives all places that share its first window. Where the word before differs too, a match begins; how far it goes is found by halving, so that
a word or passage that repeats itself costs no more than the matches that it has. A window is ten consecutive words of an item, or all words of a shorter item.

The benchmark is broadcast in blocks of a bounded size. Each block is a pass over the table; the passes' results are written between them, so that no task holds more than one block.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from quillmark.llm.common import blocks, drop_stored, large_text, per_batch, stored, unused, worker_store
from quillmark.llm.remembered import same_units
from quillmark.llm.words import FOLD, words

#: Words of a window; bytes of benchmark text in a broadcast; least and most bytes of a shard.
WINDOW, BROADCAST, _LEAST, _MOST = 10, 16 << 20, 1 << 20, 8 << 20


#: Moduli and base of the hashes that find how far a match goes; the base is drawn anew for each block of the benchmark, so no text can be made to deceive it.
_MODULI = ((1 << 31) - 1, (1 << 31) - 19)


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    """Powers 0 to ``n`` of ``base``."""
    out = np.ones(1, np.int64)
    while len(out) <= n:
        out = np.concatenate([out, out * pow(base, len(out), modulus) % modulus])
    return out[: n + 1]


def _prefixes(ids: np.ndarray, base: int, modulus: int) -> np.ndarray:
    """Sums of ids times powers of their places, before each place."""
    terms = ids % modulus * _powers(base, modulus, len(ids))[: len(ids)] % modulus
    return np.concatenate([[0], np.cumsum(terms)]) % modulus


class Benchmark:
    """A block of benchmark items: its vocabulary, pairs of neighbouring words, and the different windows with the item suffixes that begin with them.

    Of the suffixes of a window those with the same word before them stand together.
    """

    def __init__(self, items: list[tuple[str, str]]):
        raw = [t.encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        hashes, before, word_begin, word_end = words(data, offsets, ends_too=True)
        self.items, self.shard = [i for i, _ in items], int(min(max(offsets[-1], _LEAST), _MOST))
        self.data, self.base = FOLD[data], secrets.randbelow(1 << 30) + 1000
        self.vocabulary, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        size = word_end - word_begin
        self.word_begin, self.word_size, ids = word_begin[first], size[first], back.reshape(-1).astype(np.int64) + 1
        self.others: dict[int, dict[bytes, int]] = {}  # different words with one hash
        for w in np.flatnonzero(~same_units(self.data, word_begin, size, self.data, self.word_begin[ids - 1], self.word_size[ids - 1])).tolist():
            known = self.others.setdefault(int(hashes[w]), {})
            word = self.data[word_begin[w] : word_end[w]].tobytes()
            if word not in known:
                known[word] = len(self.word_begin) + 1
                self.word_begin, self.word_size = np.append(self.word_begin, word_begin[w]), np.append(self.word_size, size[w])
            ids[w] = known[word]
        self.begin, self.end = before[:-1], before[1:]
        self.ids = np.concatenate([ids, np.zeros(WINDOW, np.int64)])
        pair = (ids[:-1] << np.int64(32)) | ids[1:]
        inner = np.ones(max(len(ids) - 1, 0), bool)
        inner[before[1:-1][(before[1:-1] > 0) & (before[1:-1] < len(ids))] - 1] = False
        self.pairs = np.unique(pair[inner]) if len(pair) else np.zeros(0, np.int64)
        count = np.diff(before)
        size = np.minimum(count, WINDOW)
        runs = np.where(count > 0, count - size + 1, 0)
        item = np.repeat(np.arange(len(items)), runs)
        suffix = before[item] + np.arange(len(item)) - np.repeat(np.cumsum(runs) - runs, runs)
        length = size[item]
        cells = np.stack([np.where(k < length, self.ids[suffix + k], 0) for k in range(WINDOW)], axis=1) if len(item) else np.zeros((0, WINDOW), np.int64)
        _, first, window = np.unique(cells, axis=0, return_index=True, return_inverse=True)
        window = window.reshape(-1)
        self.first, self.lengths = suffix[first], length[first]
        left = np.where(suffix > self.begin[item], self.ids[suffix - 1], -1)  # the word before, or none
        order = np.lexsort((suffix, left, window))
        self.item, self.suffix = item[order], suffix[order]
        self.width = np.int64(len(self.word_begin) + 2)
        self.lefts = window[order] * self.width + left[order] + 1
        self.owner_at = np.searchsorted(window[order], np.arange(len(first) + 1))
        both = np.unique(window * np.int64(len(items) + 1) + item)
        self.held, self.held_at = both % (len(items) + 1), np.searchsorted(both // (len(items) + 1), np.arange(len(first) + 1))
        self.shortest = int(self.lengths.min()) if len(self.lengths) else WINDOW
        self.prefixes = [_prefixes(ids, self.base, m) for m in _MODULI]

    def numbers(self, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary from 1, 0 for others, as far as hashes tell; ``data`` is lower-cased."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        if self.others:
            for w in np.flatnonzero(np.isin(hashes, np.array(list(self.others), np.uint64))).tolist():
                ids[w] = self.others[int(hashes[w])].get(data[begin[w] : end[w]].tobytes(), ids[w])
        return ids


def suffix_array(line: np.ndarray) -> np.ndarray:
    """Places of the positive numbers in ``line``, sorted by the numbers from there up to the next 0."""
    live = np.flatnonzero(line)
    after = np.append(np.flatnonzero(line == 0), len(line))
    longest = int((after[np.searchsorted(after, live)] - live).max()) if len(live) else 0
    rank, step = np.concatenate([line, np.zeros(1, np.int64)]), 1
    while step < longest:
        key = rank[live] * (int(rank.max()) + 1) + rank[np.minimum(live + step, len(line))]
        unique, back = np.unique(key, return_inverse=True)
        rank = np.zeros_like(rank)
        rank[live] = back + 1
        if len(unique) == len(live):
            break
        step *= 2
    return live[np.argsort(rank[live], kind="stable")]


def bounds(array: np.ndarray, line: np.ndarray, sought: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each ``sought[begin:begin + length]``, the range of the suffix array ``array`` of ``line`` whose suffixes begin with it."""
    line = np.concatenate([line, np.zeros(WINDOW, np.int64)])
    out = []
    for after in (False, True):
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(array), np.int64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            right = np.full(len(open_), after)  # equal in all words
            same = np.arange(len(open_))
            for k in range(WINDOW):
                same = same[length[open_[same]] > k]
                if not len(same):
                    break
                x, y = line[array[middle[same]] + k], sought[begin[open_[same]] + k]
                right[same[x != y]] = (x < y)[x != y]
                same = same[x == y]
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
            open_ = open_[low[open_] < high[open_]]
        out.append(low)
    return out[0], out[1]


def _spread(begin: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its times."""
    return np.repeat(begin, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _common(bench: Benchmark, line: np.ndarray, at: np.ndarray, suffix: np.ndarray, sure: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words ``line[at:]`` and the benchmark's ``suffix`` have in common, at least ``sure`` and at most ``most``, by halving."""
    sides = [(m, _prefixes(line, bench.base, m), bench.prefixes[i], _powers(bench.base, m, max(len(line), len(bench.ids)))) for i, m in enumerate(_MODULI)]
    low, high = sure.copy(), most.copy()
    while len(open_ := np.flatnonzero(low < high)):
        n, a, b = (low[open_] + high[open_] + 1) // 2, at[open_], suffix[open_]
        same = np.ones(len(open_), bool)
        for m, own, other, power in sides:
            same &= (own[a + n] - own[a]) % m * power[b] % m == (other[b + n] - other[b]) % m * power[a] % m
        low[open_[same]] = n[same]
        high[open_[~same]] = n[~same] - 1
    return low


def matches(bench: Benchmark, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words before each text, marks of the words inside an occurrence of a window, the (text, item) pairs that share one, and the longest matches (text, its word, item, its word, words).

    Words are found by hashes; those inside occurrences are then compared, and if any differs all is done again without it.
    """
    hashes, before, begin, end = words(data, offsets, ends_too=True)
    folded = FOLD[data]
    ids = bench.numbers(hashes, folded, begin, end)
    while True:
        mark, held, longest = _matches(bench, ids, before)
        inside = np.flatnonzero(mark)
        own = ids[inside] - 1
        wrong = inside[~same_units(folded, begin[inside], (end - begin)[inside], bench.data, bench.word_begin[own], bench.word_size[own])] if len(inside) else inside
        if not len(wrong):
            return before, mark, held, longest
        ids[wrong] = 0


def _matches(bench: Benchmark, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, rows = len(ids), len(before) - 1
    nothing = np.zeros(n, bool), np.zeros((2, 0), np.int64), np.zeros((5, 0), np.int64)
    if not n or not len(bench.lengths):
        return nothing
    row = np.repeat(np.arange(rows), np.diff(before))
    good = np.zeros(n, bool)  # this word and the next stand together in the benchmark
    two = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0) & (row[:-1] == row[1:]))
    if len(two) and len(bench.pairs):
        pair = (ids[two] << np.int64(32)) | ids[two + 1]
        at = np.minimum(np.searchsorted(bench.pairs, pair), len(bench.pairs) - 1)
        good[two[bench.pairs[at] == pair]] = True
    first = np.flatnonzero(np.concatenate([[True], ~good[:-1]]))  # of runs
    size = np.diff(np.append(first, n))
    chosen = (size >= bench.shortest) & (ids[first] > 0)
    first, size = first[chosen], size[chosen]
    if not len(first):
        return nothing
    # the runs, each with a 0 after it
    start = np.concatenate([[0], np.cumsum(size + 1)])
    place = np.repeat(first - start[:-1], size + 1) + np.arange(start[-1])
    line = ids[np.minimum(place, n - 1)]
    line[start[1:] - 1] = 0
    array = suffix_array(line)
    low, high = bounds(array, line, bench.ids, bench.first, bench.lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return nothing
    times = (high - low)[found]
    window, at = np.repeat(found, times), array[_spread(low[found], times)]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, place[at], 1)
    np.add.at(cover, place[at] + bench.lengths[window], -1)
    # a text has an item if it has one of its windows
    both = np.unique(np.stack([window, row[place[at]]]), axis=1)
    times = bench.held_at[both[0] + 1] - bench.held_at[both[0]]
    held = np.unique(np.stack([np.repeat(both[1], times), bench.held[_spread(bench.held_at[both[0]], times)]]), axis=1)
    # a match that goes on to the left was found there: of a window's owners those with the same word before them are left out, as one range
    key = window * bench.width + np.where(at > 0, line[at - 1], 0) + 1
    gap, after = np.searchsorted(bench.lefts, key), np.searchsorted(bench.lefts, key, side="right")
    begins = np.concatenate([bench.owner_at[window], after])
    times = np.concatenate([gap, bench.owner_at[window + 1]]) - begins
    own = _spread(begins, times)
    at, window = np.repeat(np.tile(at, 2), times), np.repeat(np.tile(window, 2), times)
    item, suffix = bench.item[own], bench.suffix[own]
    stop = start[np.searchsorted(start, at, side="right")] - 1  # the 0 that ends the run
    length = _common(bench, line, at, suffix, bench.lengths[window], np.minimum(stop - at, bench.end[item] - suffix))
    text = row[place[at]]
    return np.cumsum(cover)[:-1] > 0, held, np.stack([text, place[at] - before[text], item, suffix - bench.begin[item], length])


def _blocks_of(benchmark: DataFrame, item: str, text: str):
    """Blocks of the benchmark, of at most BROADCAST bytes or one item; the driver holds one at a time."""
    part, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    for row in rows.toLocalIterator():
        if part and size + len(row.t.encode()) > BROADCAST:
            yield Benchmark(part)
            part, size = [], 0
        part.append((row.i, row.t))
        size += len(row.t.encode())
    yield Benchmark(part)


_PLACE = StructType([StructField("start", LongType()), StructField("item", StringType()), StructField("item_start", LongType()), StructField("length", LongType())])
_ADDED = StructType([StructField("n_words", LongType()), StructField("hits", BinaryType()), StructField("items", ArrayType(StringType())), StructField("matches", ArrayType(_PLACE))])


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _joined(old: pa.Array | None, new: pa.Array) -> pa.Array:
    """Each row's list of both, one after the other."""
    if old is None:
        return new
    row = np.concatenate([np.repeat(np.arange(len(x)), np.asarray(pc.list_value_length(x), np.int64)) for x in (old, new)])
    values = pa.concat_arrays([old.flatten().cast(new.type.value_type), new.flatten()])
    return _lists(np.bincount(row, minlength=len(new)), values.take(pa.array(np.argsort(row, kind="stable"))))


def _step(shared, text_at: int, name: str, first: bool):
    """Adds what a block of the benchmark has in common with each text to the column ``name``."""

    def make(batch):
        worker_store("decontaminate")
        bench = shared.value
        names = pa.array(bench.items, pa.string())
        data, offsets = large_text(batch.column(text_at).fill_null(""))
        old = None if first else batch.column(name)
        count, hits, pairs, longest, done = [], [], [], [], 0
        masks = [None] * batch.num_rows if first else old.field("hits").to_pylist()
        for low, high in blocks(offsets, bench.shard):
            at = offsets[low : high + 1]
            before, mark, held, found = matches(bench, data[at[0] : at[-1]], at - at[0])
            count.append(np.diff(before))
            for i in np.unique(held[0]).tolist():
                own, was = np.packbits(mark[before[i] : before[i + 1]]), masks[low + i]
                masks[low + i] = (own if was is None else own | np.frombuffer(was, np.uint8)).tobytes()
            held[0] += low
            found[0] += low
            pairs.append(held)
            longest.append(found[:, np.argsort(found[0], kind="stable")])
        pairs, longest = np.concatenate(pairs, axis=1), np.concatenate(longest, axis=1)
        rows = batch.num_rows
        places = pa.StructArray.from_arrays([pa.array(longest[1]), names.take(pa.array(longest[2])), pa.array(longest[3]), pa.array(longest[4])], ["start", "item", "item_start", "length"])
        items = _joined(None if first else old.field("items"), _lists(np.bincount(pairs[0], minlength=rows), names.take(pa.array(pairs[1]))))
        places = _joined(None if first else old.field("matches"), _lists(np.bincount(longest[0], minlength=rows), places))
        added = pa.StructArray.from_arrays([pa.array(np.concatenate(count)), pa.array(masks, pa.binary()), items, places], ["n_words", "hits", "items", "matches"])
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != name]
        return pa.RecordBatch.from_arrays([*(c for _, c in kept), added], [*(n for n, _ in kept), name])

    return per_batch(make)


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: (n_words, hits: a bit for each word, packed, null if none is hit, items, matches: the longest verbatim ones).

    Null and empty texts have no words; items without words have no windows. A null item_id counts as the empty string; items of the
    same id are one item. Without benchmark items nothing is hit. Repeated rows have their own results, texts may have any length, and the columns of ``docs`` may have any names.
    """
    spark, (name,) = docs.sparkSession, unused(docs, "__found")
    fields = list(docs.schema.fields)
    out = docs
    for i, bench in enumerate(_blocks_of(benchmark, item, item_text)):
        if i:
            before, out = out, stored(out, "passes")
            drop_stored(before)
        shared = spark.sparkContext.broadcast(bench)
        out = out.mapInArrow(_step(shared, docs.columns.index(text), name, i == 0), StructType([*fields, StructField(name, _ADDED)]))
    return out, name


def _listed(places: pa.Array) -> tuple[str, int]:
    """Different matches in order, as text, and the words of the longest."""
    if not len(places):
        return "", 0
    start, item, item_start, length = (places.field(c) for c in ("start", "item", "item_start", "length"))
    code = item.dictionary_encode()
    names = np.array([x.encode() for x in code.dictionary.to_pylist()], object)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(names, kind="stable")] = np.arange(len(names))
    keys = np.stack([np.asarray(start, np.int64), rank[np.asarray(code.indices, np.int64)], np.asarray(item_start, np.int64), np.asarray(length, np.int64)])
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)
    chosen = pa.array(order[new])
    texts = [x.take(chosen).cast(pa.string()) for x in (start, item, item_start, length)]
    one = pc.binary_join_element_wise(*texts, ":")
    return pc.binary_join(_lists(np.array([len(one)]), one), ",")[0].as_py(), int(keys[3].max())


def _summary(name: str, at: int):
    def make(batch):
        found = batch.column(at)
        rows = []
        for n, hits, items, places in zip(found.field("n_words").to_pylist(), found.field("hits").to_pylist(), found.field("items").to_pylist(), found.field("matches")):
            mark = np.unpackbits(np.frombuffer(hits or b"", np.uint8))
            items = sorted(set(items))
            listed, longest = _listed(places.values)
            rows.append((n, int(mark.sum()), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), longest, listed))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *new[:4], pa.array([r[1] > 0 for r in rows]), *new[4:]], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "matches"])

    return per_batch(make)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, matches) of every row; see ``with_matches`` for nulls and other cases.

    ``matches`` lists the longest verbatim matches as word:item:word of the item:words, comma-joined, in order; ``longest`` is the length of the longest one.
    """
    only = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out, name = with_matches(only, benchmark, "text", item, item_text)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, matches string"
    return out.select("doc_id", name).mapInArrow(_summary(name, 1), schema)


def hit(found: str) -> Column:
    """True where a row of ``with_matches`` shares a window with the benchmark."""
    return F.col(f"`{found}`.hits").isNotNull()


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with the columns that they had; see ``with_matches`` for nulls and other cases."""
    out, name = with_matches(docs, benchmark, text, item, item_text)
    return out.where(~hit(name)).select(*(F.col(f"`{c}`") for c in docs.columns))
