"""Text quality by a support vector machine over naive Bayes features.

A text is the set of its n-grams: words and pairs of words, in lower case, and runs of one to three word shapes (capitals, small letters, digits and each symbol, runs counted once; a word that
repeats the one before it is a shape of its own; the text's ends are marked). N-grams are hashed to BUCKETS indicators. An indicator is scaled by the log of the ratio of its
shares in good and in bad texts, counted over all labelled rows that are learnt from, and a text's vector has length 1. A linear model with hinge loss is then fitted by dual coordinate
descent on a sample of bounded size, and its margins become probabilities by a logistic curve that is fitted to margins of texts held out of the fit in turn.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import blocks, drop_stored, large_text, per_batch, small, stored, worker_store
from quillmark.llm.words import mix, shingles, words

#: Bits of a bucket's number; most texts of the sample and most bytes, of which each class has half.
BITS, SAMPLE, SAMPLE_BYTES = 18, 10_000, 64 << 20
BUCKETS = 1 << BITS
#: Count that every bucket has in both classes beforehand; cost of a violated margin; passes over the sample; share of the fitted weights, the rest being their mean; parts for the logistic curve; least score that counts as good.
PRIOR, COST, PASSES, OWN, PARTS, THRESHOLD = 1.0, 1.0, 12, 0.75, 3, 0.3
_WORD = np.arange(1, 257, dtype=np.uint16)
_WORD[0x41:0x5B] += 32
_SHAPE = np.arange(8, 264, dtype=np.uint16)
_SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x30:0x3A], _SHAPE[0x80:] = 1, 2, 3, 2
for _t in (_WORD, _SHAPE):
    _t[[0x20, *range(0x09, 0x0E)]] = 0
_SAME = np.arange(1 << 9, dtype=np.uint16)
_BEGIN, _END, _REPEAT = (np.uint64(x) for x in (0x51ED270B7A6F0C35, 0xA24BAED4963EE407, 0x9FB21C651E98DF25))


def _salted(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x632BE59BD9B4E019 * (kind + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each text in order, each once, and where a text's begin (one entry more than texts). A text without words has the bucket of its ends alone."""
    rows = len(offsets) - 1
    token, before = words(data, offsets, _WORD)
    shape = _SHAPE[data]
    new = np.ones(len(data), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    form, form_before = words(shape[new], np.concatenate([[0], np.cumsum(new)])[offsets], _SAME)
    repeats = np.zeros(len(token), bool)
    repeats[1:] = token[1:] == token[:-1]
    repeats[before[:-1][before[:-1] < len(token)]] = False
    form[repeats] = _REPEAT
    # the shapes of a text between its ends
    count = np.diff(form_before)
    row = np.repeat(np.arange(rows), count)
    line = np.empty(len(form) + 2 * rows, np.uint64)
    ends_before = form_before + 2 * np.arange(rows + 1)
    line[ends_before[:-1]], line[ends_before[1:] - 1] = _BEGIN, _END
    line[np.arange(len(form)) + 2 * row + 1] = form
    found = [(np.repeat(np.arange(rows), np.diff(before)), _salted(token, 0))]
    for kind, (hashes, start, size) in enumerate(((token, before, 2), (line, ends_before, 1), (line, ends_before, 2), (line, ends_before, 3)), 1):
        runs, at = shingles(hashes, start, size)
        found.append((np.repeat(np.arange(rows), np.diff(at)), _salted(runs, kind)))
    key = np.unique(np.concatenate([r << BITS | b for r, b in found]))
    return (key & (BUCKETS - 1)).astype(np.int32), np.searchsorted(key, np.arange(rows + 1) << BITS)


@dataclass
class Model:
    """Log-count ratio and weight of each bucket, intercept, and the logistic curve of the margin; without examples of both classes the score is their share alone."""

    ratios: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float
    level: float

    def scores(self, buckets: np.ndarray, start: np.ndarray) -> np.ndarray:
        r = self.ratios[buckets].astype(np.float64)
        length = np.sqrt(np.maximum(np.add.reduceat(r * r, start[:-1]), 1e-12)) if len(buckets) else np.ones(len(start) - 1)
        margin = np.add.reduceat(r * self.weights[buckets], start[:-1]) / length + self.intercept if len(buckets) else np.zeros(len(start) - 1)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.level, -500.0, 500.0)))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = COST, passes: int = PASSES, seed: int = 13) -> np.ndarray:
    """Weights, the intercept last, of least w.w / 2 + cost * sum(max(0, 1 - y w.x)); a row is (places, values) of length 1, and each has a 1 for the intercept.

    One dual variable at a time is set to its best value between 0 and ``cost``, in a new order in each pass, and the weights follow it.
    """
    weights, dual, order = np.zeros(size + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)).tolist():
            at, value = rows[i]
            slope = y[i] * (float(weights[at] @ value) + weights[size]) - 1.0
            now = min(max(dual[i] - slope / norm[i], 0.0), cost)
            step = now - dual[i]
            if step:
                dual[i] = now
                weights[at] += step * y[i] * value
                weights[size] += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return weights


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level of the curve 1 / (1 + exp(-(slope m + level))) of least weighted log loss, with targets a little inside 0 and 1; the slope is never negative."""
    good, bad = weight[y > 0].sum(), weight[y < 0].sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, float(np.log((good + 1) / (bad + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g, h = weight * (p - target), np.maximum(weight * p * (1 - p), 1e-12)
        hess = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * margin).sum() + 1e-6 * a, g.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def fitted(ratios: np.ndarray, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> Model:
    """A model from the buckets, class (1 or -1) and weight of each text of the sample, in an order that doesn't depend on partitions."""
    rows = []
    for buckets in texts:
        r = ratios[buckets].astype(np.float64)
        rows.append((buckets, r / np.sqrt(max(float(r @ r), 1e-12))))

    def fit(chosen: np.ndarray) -> np.ndarray:
        w = dual_descent([rows[i] for i in chosen], y[chosen], len(ratios))
        w[:-1] = OWN * w[:-1] + (1 - OWN) * np.abs(w[:-1]).sum() / len(ratios)
        return w

    margin, part = np.zeros(len(rows)), np.arange(len(rows)) % PARTS
    for k in range(PARTS):
        if len(np.unique(y[part != k])) == 2:
            w = fit(np.flatnonzero(part != k))
            for i in np.flatnonzero(part == k):
                margin[i] = w[rows[i][0]] @ rows[i][1] + w[-1]
    slope, level = logistic(margin, y, weight)
    w = fit(np.arange(len(rows)))
    return Model(ratios, w[:-1].astype(np.float32), float(w[-1]), slope, level)


def remainder(key: Column) -> Column:
    """crc32 of a key's text, modulo 5: rows of remainder 0 are held out."""
    return F.crc32(key.cast("string")) % 5


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, quality: str) -> tuple[DataFrame, DataFrame]:
    """(key, text, good, order) of the rows that are learnt from, and the stored table of their labels."""
    label = F.col(f"`{quality}`").cast("int")
    each = labels.where(F.col(f"`{key}`").isNotNull() & label.isin(0, 1) & (remainder(F.col(f"`{key}`").cast("long")) != 0))
    each = each.groupBy(F.col(f"`{key}`").cast("long").alias("key")).agg(F.min(label).alias("good"), F.max(label).alias("other")).where("good = other").select("key", "good")
    held = stored(each, "labels")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.join(small(held), "key").withColumn("order", F.xxhash64("key", "text")), held


def _blocks_of(batch, at: int):
    data, offsets = large_text(batch.column(at))
    for low, high in blocks(offsets, 1 << 20):
        own = offsets[low : high + 1]
        yield low, high, *features(data[own[0] : own[-1]], own - own[0])


def _count(batches):
    """Texts that hold each bucket, by class; texts and bytes of each class stand at buckets -1 and -2."""
    total = np.zeros((2, BUCKETS), np.int64)
    sizes = np.zeros((2, 2), np.int64)
    for batch in batches:
        if batch.num_rows:
            worker_store("nb_svm")
            good = np.asarray(batch.column(1), np.int64)
            length = np.diff(large_text(batch.column(0))[1])
            for k in (0, 1):
                sizes[:, k] += (good == k).sum(), length[good == k].sum()
            for low, high, buckets, start in _blocks_of(batch, 0):
                kind = np.repeat(good[low:high], np.diff(start))
                for k in (0, 1):
                    total[k] += np.bincount(buckets[kind == k], minlength=BUCKETS)
    own = np.flatnonzero(total.any(axis=0))
    if sizes.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], own]).astype(np.int32)), pa.array(np.concatenate([sizes[:, 0], total[0, own]])), pa.array(np.concatenate([sizes[:, 1], total[1, own]]))], ["bucket", "bad", "good"])


def _sets(batch):
    out = []
    for _, _, buckets, start in _blocks_of(batch, 0):
        out += [buckets[a:b].astype("<i4").tobytes() for a, b in zip(start[:-1].tolist(), start[1:].tolist())]
    return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1), batch.column(2), batch.column(3)], ["buckets", "good", "order", "key"])


def _fit_in_task(shared, weights: tuple[float, float]):
    def run(batches):
        rows = [r for b in batches for r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(1).to_pylist(), b.column(0).to_pylist())]
        rows.sort()
        if rows:
            good = np.array([r[2] for r in rows])
            model = fitted(shared.value, [np.frombuffer(r[3], "<i4") for r in rows], np.where(good == 1, 1.0, -1.0), np.where(good == 1, weights[1], weights[0]))
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.intercept]), pa.array([model.slope]), pa.array([model.level])], ["weights", "intercept", "slope", "level"])

    return run


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the rows that have a key, aren't held out and have one label, 0 or 1; keys whose labels differ aren't learnt from, repeated rows count as often as they occur.

    Counts and ratios are over all of these rows. The descent takes about half of ``sample`` and of ``sample_bytes`` from each class (all of a class that has fewer), those of the smallest
    hashes of key and text; the curve weighs them back to their classes' sizes. Without labelled rows every score is 0.5, with one class only it is near that class.
    """
    spark = docs.sparkSession
    rows, held = _labelled(docs, labels, key, text, quality)
    counted = rows.select("text", "good").mapInArrow(_count, "bucket int, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    count = np.zeros((2, BUCKETS))
    sizes = {}
    for r in counted.collect():  # BUCKETS rows at most
        if r.bucket < 0:
            sizes[r.bucket] = (r.bad, r.good)
        else:
            count[:, r.bucket] = r.bad, r.good
    n, size = sizes.get(-1, (0, 0)), sizes.get(-2, (0, 0))
    p = count + PRIOR
    p /= p.sum(axis=1, keepdims=True)
    ratios = np.log(p[1] / p[0]).astype(np.float32)
    if not all(n):
        drop_stored(held)
        return Model(ratios, np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log((n[1] + 1) / (n[0] + 1))))
    share = [min(1.0, sample / 2 / n[k], sample_bytes / 2 / max(size[k], 1)) for k in (0, 1)]
    place = F.col("order").cast("double") / F.lit(2.0**64) + 0.5
    chosen = rows.where(place < F.when(F.col("good") == 1, share[1]).otherwise(share[0])).select("text", "good", "order", "key")
    shared = spark.sparkContext.broadcast(ratios)
    sets = chosen.mapInArrow(per_batch(_sets), "buckets binary, good int, order long, key long").repartition(1)
    got = sets.mapInArrow(_fit_in_task(shared, (1 / share[0], 1 / share[1])), "weights binary, intercept double, slope double, level double").first()
    drop_stored(held)
    if got is None:
        return Model(ratios, np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log((n[1] + 1) / (n[0] + 1))))
    return Model(ratios, np.frombuffer(got.weights, np.float32), got.intercept, got.slope, got.level)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row, from its whole text alone; a null text counts as empty, and empty texts have the score of a text that ends where it begins."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        worker_store("nb_svm")
        found = [shared.value.scores(buckets, start) for _, _, buckets, start in _blocks_of(batch, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["doc_id", "score"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(per_batch(make), "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted): fits on the labelled rows that aren't held out and scores every row.

    A null key is neither held out nor learnt from; repeated rows have a row each; texts may have any length; other columns don't matter; an empty table gives no rows.
    """
    out = scored(docs, fit(docs, labels, key, text, quality), key, text)
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
