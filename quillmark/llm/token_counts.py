"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers are run one inside the other. The first cuts text into pre-tokens: it reads character classes, and each transition says
whether a pre-token begins before the character it reads or before the one it read last. Texts are laid end to end and cut into
chunks of equal length; every chunk is run from all states at once, which gives its state map, the maps are
composed by a parallel prefix scan, and a second run from each chunk's true first state emits the cuts.

The second, ``MergeTransducer``, reads the bytes of a pre-token; each transition is annotated with the tokens that it emits. Its states are compiled from the
tokenizer's merges as texts ask for them. Annotated sums of whole words are remembered with the words themselves, which are compared character by character.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmark.llm.common import blocks, per_batch, texts
from quillmark.llm.remembered import Remembered, unit_keys

#: Characters in a chunk, bytes worked on at once, words in a worker's table.
CHUNK, BLOCK, TABLE = 128, 1 << 20, 600_000
#: Classes of characters. The letters of contractions are letters with a class of their own.
CLASSES = ("letter", "digit", "space", "white", "other", "quote", "stmd", "r", "e", "v", "l", "reset")
STATES = ("start", "letters", "digits", "others", "space", "spaces", "white", "whites", "quote", "quote_r", "quote_v", "quote_l", "done")
_LETTERS = {"letter", "stmd", "r", "e", "v", "l"}


def compiled() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output of each (state, class); output 1: a cut before this character, 2: a cut before the one read last.

    States "space" and "white" hold a run of one white-space character that ends in a space or another one, "spaces" and "whites" a
    longer run. The last character of a run before other text is cut off from it; a space then joins the text.
    """
    step = np.zeros((len(STATES), len(CLASSES)), np.uint8)
    out = np.zeros((len(STATES), len(CLASSES)), np.uint8)
    at = {name: i for i, name in enumerate(STATES)}
    for s in STATES:
        for c, kind in enumerate(CLASSES):
            letter, white = kind in _LETTERS, kind in ("space", "white")
            cut = 0
            if kind == "reset":
                to = "start"
            elif white:
                run = s in ("space", "spaces", "white", "whites")
                to = kind + ("s" if run else "")
                cut = 0 if run else 1
            else:
                to = "letters" if letter else {"digit": "digits", "other": "others", "quote": "others"}[kind]
                if s in ("space", "spaces"):
                    cut = 2 if s == "spaces" else 0  # the space begins this pre-token
                elif s in ("white", "whites"):
                    cut = 1 + 2 * (s == "whites")
                    to = "quote" if kind == "quote" else to
                elif s in ("start", "done", "letters", "digits"):
                    same = s == to
                    cut = 0 if same else 1
                    to = "quote" if kind == "quote" else to
                elif s == "others":
                    cut = 0 if to == "others" else 1
                elif s == "quote":
                    if kind == "stmd":
                        to = "done"
                    elif kind in ("r", "v", "l"):
                        to = f"quote_{kind}"
                    else:
                        cut = 0 if to == "others" else 1
                else:  # a quote and the first letter of 're, 've or 'll
                    second = {"quote_r": "e", "quote_v": "e", "quote_l": "l"}[s]
                    if kind == second:
                        to = "done"
                    elif letter:
                        cut = 2  # no contraction: the letter before began a word
                    else:
                        cut = 3
                        to = "quote" if kind == "quote" else to
            if white and s in ("quote_r", "quote_v", "quote_l"):
                cut = 3
            if kind == "reset" and s in ("quote_r", "quote_v", "quote_l"):
                cut = 2
            step[at[s], c], out[at[s], c] = at[to], cut
    return step, out


@functools.cache
def _class_of() -> np.ndarray:
    """Class of every code point; the lone surrogate D800 separates texts."""
    kinds = np.full(0x110000, CLASSES.index("other"), np.uint8)
    for i in range(0x110000):
        category = unicodedata.category(chr(i))
        if category[0] == "L":
            kinds[i] = CLASSES.index("letter")
        elif category[0] == "N":
            kinds[i] = CLASSES.index("digit")
    white = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kinds[white] = CLASSES.index("white")
    kinds[0x20] = CLASSES.index("space")
    kinds[0x27] = CLASSES.index("quote")
    for c, name in (("s", "stmd"), ("t", "stmd"), ("m", "stmd"), ("d", "stmd"), ("r", "r"), ("e", "e"), ("v", "v"), ("l", "l")):
        kinds[ord(c)] = CLASSES.index(name)
    kinds[0xD800] = CLASSES.index("reset")
    return kinds


@functools.cache
def _machine() -> tuple[np.ndarray, np.ndarray]:
    step, out = compiled()
    return step.reshape(-1), out.reshape(-1)


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps (chunks, states): ``then`` after ``first``."""
    return np.take_along_axis(then, first, axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix composition of state maps, in log2(chunks) rounds."""
    out, gap = maps.copy(), 1
    while gap < len(out):
        out[gap:] = compose(out[:-gap], out[gap:])
        gap *= 2
    return out


def cuts(points: np.ndarray) -> np.ndarray:
    """Marks the code points before which a pre-token begins."""
    step, out = _machine()
    n, wide = len(points), len(CLASSES)
    chunks = -(-n // CHUNK)
    kinds = np.full(chunks * CHUNK, CLASSES.index("reset"), np.uint8)
    kinds[:n] = _class_of()[points]
    kinds = np.ascontiguousarray(kinds.reshape(chunks, CHUNK).T).astype(np.intp)
    state = np.repeat(np.arange(len(STATES), dtype=np.uint8)[:, None], chunks, axis=1)
    for k in range(CHUNK):
        state = step[state.astype(np.intp) * wide + kinds[k]]
    maps = prefix_scan(np.ascontiguousarray(state.T).astype(np.intp))
    now = np.concatenate([[0], maps[:-1, 0]]).astype(np.intp)
    given = np.empty((CHUNK, chunks), np.uint8)
    for k in range(CHUNK):
        at = now * wide + kinds[k]
        given[k] = out[at]
        now = step[at].astype(np.intp)
    given = np.ascontiguousarray(given.T).reshape(-1)[:n]
    mark = (given & 1).astype(bool)
    mark[:-1] |= (given[1:] & 2).astype(bool)
    return mark


class MergeTransducer:
    """Counts the tokens of a byte string under ranked merges, one byte at a time.

    Of all prefixes of a pre-token, each has one encoding, and that of a prefix is that of a shorter prefix and one token more: the token that ends there
    whose neighbour before it stays apart from it when both are merged. So after each byte the machine only needs, for every place from which
    a token may still go on (the bytes since then begin a token), the last token before that place and how many tokens the encoding had there, less those that
    it has now. These are its states; a transition is annotated with the change of the number of tokens. States and transitions are made once each.
    """

    def __init__(self, merges: list[tuple[str, str]], letters: list[str], most: int = 400_000):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.halves = {}
        for i, (a, b) in enumerate(merges):
            self.halves.setdefault(a + b, (a, b, i))
        self.letters, self.most = letters, most
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[str | None] = [None]
        byte_of = {c: b for b, c in enumerate(letters)}
        for token in (*letters, *self.halves):
            node = 0
            for c in token:
                b = byte_of[c]
                below = self.trie[node].get(b)
                if below is None:
                    below = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(None)
                node = below
            self.token_at[node] = token
        self.real: dict[str, bool] = {}
        self.spines: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.apart_of: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forgets all states."""
        self.names: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.steps: list[dict[int, tuple[int, int]]] = []
        self.start = self._state(((0, None, 0),))

    def _state(self, key: tuple) -> int:
        found = self.names.get(key)
        if found is None:
            found = self.names[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
        return found

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The symbols at the left (0) or right (1) end of a token while it is merged from bytes, each with the rank of the merge that takes it in."""
        found = self.spines.get((token, side))
        if found is None:
            found, now, taken = [], token, len(self.rank) + 1
            while True:
                found.append((now, taken))
                halves = self.halves.get(now)
                if halves is None:
                    break
                now, taken = halves[side], halves[2]
            found.reverse()
            self.spines[token, side] = found
        return found

    def _apart(self, a: str, b: str) -> bool:
        """True if ``a`` followed by ``b`` stay two tokens: no merge over the border between them comes before the merges that make them."""
        known = self.apart_of.get((a, b))
        if known is None:
            left, right, i, j, known = self._spine(a, 1), self._spine(b, 0), 0, 0, True
            while True:
                (x, x_goes), (y, y_goes) = left[i], right[j]
                over = self.rank.get((x, y))
                # of equal merges the leftmost comes first: one inside ``a`` before that over the border, and that before one inside ``b``
                if over is not None and over < x_goes and over <= y_goes:
                    known = False
                    break
                if i + 1 == len(left) and j + 1 == len(right):
                    break
                if x_goes <= y_goes:
                    i += 1
                else:
                    j += 1
            self.apart_of[a, b] = known
        return known

    def _is_real(self, token: str) -> bool:
        """True if the bytes of a vocabulary entry are encoded as that entry: its halves are, and they stay apart until they are merged."""
        known = self.real.get(token)
        if known is None:
            halves = self.halves.get(token)
            if halves is None:
                known = True
            else:
                a, b, at = halves
                known = self._is_real(a) and self._is_real(b)
                left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
                while known and (i + 1 < len(left) or j + 1 < len(right)):
                    (x, x_goes), (y, y_goes) = left[i], right[j]
                    over = self.rank.get((x, y))
                    if over is not None and over < x_goes and over <= y_goes:
                        known = False
                    elif x_goes <= y_goes:
                        i += 1
                    else:
                        j += 1
            self.real[token] = known
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        going, best = [], None
        for node, last, count in self.keys[state]:
            to = self.trie[node].get(byte)
            if to is None:
                continue
            going.append((to, last, count))
            if best is None:
                token = self.token_at[to]
                if token is not None and self._is_real(token) and (last is None or self._apart(last, token)):
                    best = token, count + 1
        token, emitted = best
        key = tuple((to, last, count - emitted) for to, last, count in going if self.trie[to]) + ((0, token, 0),)
        step = self.steps[state][byte] = self._state(key), emitted
        return step

    def tokens(self, word: bytes) -> int:
        """Tokens of a pre-token: the sum over the transitions that it takes."""
        if len(self.keys) > self.most:
            self.clear()
        state, total, steps = self.start, 0, self.steps
        for byte in word:
            step = steps[state].get(byte) or self._compile(state, byte)
            state = step[0]
            total += step[1]
        return total


class Counter:
    """Token counts under one tokenizer file of merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in spec["model"]["merges"]]
        self.machine = MergeTransducer(merges, byte_letters())
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.known = Remembered(TABLE, "<u4", "<i8")

    def count(self, rows: list[str]) -> np.ndarray:
        """Tokens of each text; strings of added tokens are one token each, and text goes on anew after them."""
        extra = np.zeros(len(rows), np.int64)
        for i, text in enumerate(rows):
            for mark in self.special:
                if mark in text:
                    extra[i] += text.count(mark)
                    text = text.replace(mark, "\ud800")
            rows[i] = text
        points = np.frombuffer("\ud800".join(rows).encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(points):
            return extra
        mark = cuts(points)
        begin = np.flatnonzero(mark)
        if not len(begin):
            return extra
        real = points != 0xD800
        ends = np.append(begin[1:], len(points))
        gaps = np.flatnonzero(~real)
        if len(gaps):  # a pre-token ends at a separator
            after = np.searchsorted(gaps, begin)
            stop = np.append(gaps, len(points))[after]
            ends = np.minimum(ends, stop)
        tokens = self.machine.tokens
        make = lambda own: [(tokens(points[begin[i] : ends[i]].tobytes().decode("utf-32-le").encode()),) for i in own]
        slots = self.known.slots_of(unit_keys(points, begin, ends), points, begin, ends, make)
        counts = self.known.values[self.known.at[slots]]
        lengths = np.array([len(t) for t in rows]) + 1
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        sums = np.concatenate([[0], np.cumsum(counts)])
        at = np.searchsorted(begin, np.append(starts, len(points) + 1))
        return extra + sums[at[1:]] - sums[at[:-1]]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the file's vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


@functools.cache
def counter(path: str) -> Counter:
    """The counter of a tokenizer file, compiled once in each worker."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, repeated rows included.

    Null and empty texts have no bytes and no tokens; texts may have any length; a null key stays null; an empty table gives no rows. Other columns don't matter.
    """

    def make(batch):
        use, rows = counter(path), batch.column(1).to_pylist()
        size = np.array([len(t.encode()) for t in rows], np.int64)
        count = np.zeros(len(rows), np.int64)
        for low, high in blocks(np.concatenate([[0], np.cumsum(size)]), BLOCK):
            count[low:high] = use.count(rows[low:high])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(count), pa.array(count > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs, key, text).mapInArrow(per_batch(make), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
