"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree with frozen counts, from a bounded sample of labelled texts. The code length of a byte is
found by following its contexts from the longest down: an unseen byte in a seen context costs that context's escape, a
seen one ends the walk, and a byte seen nowhere costs eight bits (escape method C). The language with the shortest code for the whole text is predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.llm.common import blocks, drop_stored, large_text, per_batch, small, stored

#: Longest context in bytes, and the bound of the sample: texts of a language, characters that are learnt from the beginning of a text in it.
ORDER, SAMPLE, LONGEST = 4, 400, 20_000
#: How many times the sample is ranked to find it.
SPARE = 4
#: Grams whose code lengths a worker remembers; evidence of a text counts as that of this many bytes at most.
MEMORY, EVIDENCE = 400_000, 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LETTER = regex.compile(r"\p{L}").search


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it in its text, as one integer, newest byte lowest; texts begin after line feeds."""
    rows = len(offsets) - 1
    at = np.arange(len(data)) + ORDER * (1 + np.repeat(np.arange(rows), np.diff(offsets)))
    padded = np.full(len(data) + ORDER * (rows + 1), 0x0A, np.uint8)
    padded[at] = _LOWER[data]
    out = np.zeros(len(data), np.uint64)
    for k in range(ORDER, -1, -1):
        out = (out << np.uint64(8)) | padded[at - k]
    return out


class Trees:
    """Frozen context trees of one language: for each order the contexts' totals and distinct bytes, and the bytes' counts."""

    def __init__(self, grams: np.ndarray):
        self.orders = []
        for k in range(ORDER + 1):
            gram, count = np.unique(grams & np.uint64((1 << (8 * (k + 1))) - 1), return_counts=True)
            context, first = np.unique(gram >> np.uint64(8), return_index=True)
            total = np.add.reduceat(count, first) if len(first) else count
            distinct = np.diff(np.append(first, len(gram)))
            self.orders.append((gram, count.astype(np.float64), context, total.astype(np.float64), distinct.astype(np.float64)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Exact code length of each gram's last byte after its context."""
        out, going = np.zeros(len(grams)), np.ones(len(grams), bool)
        for k in range(ORDER, -1, -1):
            gram, count, context, total, distinct = self.orders[k]
            if not len(gram):
                continue
            own = grams & np.uint64((1 << (8 * (k + 1))) - 1)
            c = np.minimum(np.searchsorted(context, own >> np.uint64(8)), len(context) - 1)
            known = going & (context[c] == own >> np.uint64(8))
            g = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
            seen = known & (gram[g] == own)
            out[seen] += np.log2((total[c] + distinct[c])[seen] / count[g][seen])
            escaped = known & ~seen
            out[escaped] += np.log2((total[c] + distinct[c])[escaped] / distinct[c][escaped])
            going &= ~seen
        out[going] += 8.0
        return out


class Model:
    """Trees of all languages, and the code lengths found so far."""

    def __init__(self, texts_by_lang: dict[str, list[str]]):
        self.langs = sorted(texts_by_lang)
        self.trees = []
        for lang in self.langs:
            raw = [t.encode() for t in texts_by_lang[lang]]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
            self.trees.append(Trees(_grams(np.frombuffer(b"".join(raw), np.uint8), offsets)))
        self.known, self.table = np.zeros(0, np.uint64), np.zeros((0, len(self.langs)))

    def _lengths(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, grams)
        at[at == len(self.known)] = 0
        old = self.known[at] == grams if len(self.known) else np.zeros(len(grams), bool)
        if old.all():
            return self.table[at]
        new = grams[~old]
        found = np.stack([t.bits(new) for t in self.trees], axis=1)
        out = np.empty((len(grams), len(self.langs)))
        out[~old] = found
        if old.any():
            out[old] = self.table[at[old]]
        if len(self.known) > MEMORY:
            self.known, self.table = grams, out
        else:
            keys, rows = np.concatenate([self.known, new]), np.concatenate([self.table, found])
            order = np.argsort(keys)
            self.known, self.table = keys[order], rows[order]
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        rows = len(offsets) - 1
        row = np.repeat(np.arange(rows), np.diff(offsets))
        unique, back = np.unique(_grams(data, offsets), return_inverse=True)
        lengths = self._lengths(unique)
        return np.stack([np.bincount(row, lengths[back, i], rows) for i in range(len(self.langs))], axis=1)


def remainder(key: Column) -> Column:
    """crc32 of a key's text, modulo 5: the texts of remainder 0 are held out."""
    return F.crc32(key.cast("string")) % 5


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from at most SAMPLE different texts for each label, those of the smallest hashes; of a longer text its first LONGEST characters are learnt from.

    Only rows that are not held out and have a key, a text and a label are learnt from.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    rows = rows.where((remainder(F.col("key")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("hash", F.xxhash64("text"))
    each = stored(rows.groupBy("lang", "hash").agg(F.min("key").alias("key")), "texts")
    # hashes are spread evenly over their range: below SPARE times the share that the sample has of a label's texts there are always enough, and few to rank
    size = each.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("hash").cast("double") / F.lit(2.0**64) + 0.5
    best = each.join(small(size), "lang").where(share * F.col("n") <= SAMPLE * SPARE)
    best = best.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("hash"))).where(F.col("place") <= SAMPLE)
    chosen = best.select("lang", "hash", "key").collect()  # at most SAMPLE of each label
    drop_stored(each)
    if not chosen:
        return Model({})
    picked = docs.sparkSession.createDataFrame([tuple(x) for x in chosen], best.select("lang", "hash", "key").schema)
    sample: dict[str, dict[int, str]] = {}
    for row in rows.join(F.broadcast(picked), ["lang", "hash", "key"], "left_semi").select("lang", "hash", F.substring("text", 1, LONGEST).alias("text")).collect():
        sample.setdefault(row.lang, {})[row.hash] = row.text
    return Model({k: [v[h] for h in sorted(v)] for k, v in sample.items()})


def predicted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; ``und`` and 0 for texts that are null or hold no letter (\\p{L}), or without a model.

    Whole texts of any length are read; of languages with equally short codes the first by name is taken; repeated rows have a row each, and other columns don't matter.
    The score is the predicted language's share of the probability, the evidence of a text counted as that of EVIDENCE bytes at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        use = shared.value
        raw = batch.column(1)
        data, offsets = large_text(raw.fill_null(""))
        best, score = np.zeros(len(raw), np.int64), np.zeros(len(raw))
        if use.langs:
            for low, high in blocks(offsets, 1 << 20):
                at = offsets[low : high + 1]
                bits = use.bits(data[at[0] : at[-1]], at - at[0]).astype(float)
                gap = bits - bits.min(axis=1, keepdims=True)
                gap *= np.minimum(1.0, EVIDENCE / np.maximum(np.diff(at), 1))[:, None]
                best[low:high] = bits.argmin(axis=1)
                score[low:high] = 1.0 / np.exp2(-np.minimum(gap, 1000.0)).sum(axis=1)
        letters = [bool(use.langs) and t is not None and _LETTER(t) is not None for t in raw.to_pylist()]
        names = [use.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(per_batch(make), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fits on the rows that aren't held out and predicts every row. A null key is neither held out nor learnt from."""
    out = predicted(docs, fit(docs, key, text, lang), key, text)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
