"""The operators on labels, vectors and filters against plain versions, with nulls, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from quillmark.llm import centroids, filter_audit, nb_svm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- centroids


def plain_clusters(rows, size, clusters, rounds):
    """{row: (cluster, distance)}, totals and centroids by integers alone."""
    kept = [(i, k, [math.floor(256 * float(x)) for x in v]) for i, (k, v) in enumerate(rows) if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{'' if k is None else k}".encode()).hexdigest(), q) for _, k, q in kept)
    now = [q for _, q in seeds[:clusters]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, _, q in kept:
            own[near(q)[1]].append(q)
        now = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else c for j, c in enumerate(now)]
    found = [(k, *near(q)) for _, k, q in kept]
    total = collections.Counter()
    for _, d, j in found:
        total[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((k, j, d, total[j], sum(total.values()), digest[j]) for k, d, j in found), key=repr)


def test_clusters_against_integers_alone(spark):
    draw = random.Random(5)
    point = lambda: [draw.choice([-1.0, -0.5, 0.0, 0.25, 0.5]) for _ in range(4)]  # few values: many ties
    rows = [(i, point()) for i in range(300)] + [(i, [draw.gauss(0, 3) for _ in range(4)]) for i in range(300, 500)]
    rows += [(7, [0.5] * 4), (7, [0.5] * 4), (None, [0.1] * 4), (None, [-0.1] * 4), (901, None), (902, [1.0] * 3), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan")] * 4), (905, [1.0, 2.0, float("inf"), 0.0]), (906, [])]
    rows += [(2000 + i, [0.0] * 4) for i in range(400)]  # one vector that holds many rows
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<double>, cluster int, q string").repartition(5)
    for clusters in (1, 12, 40):
        got = sorted((tuple(r) for r in centroids.clusters_of(df, size=4, clusters=clusters, rounds=4).collect()), key=repr)
        assert got == plain_clusters(rows, 4, clusters, 4)
    assert sorted(tuple(r) for r in centroids.clusters_of(df.where("vec_id < 5"), size=4).collect()) == plain_clusters([r for r in rows if r[0] is not None and r[0] < 5], 4, 40, 5)
    assert centroids.clusters_of(df.where("false"), size=4).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        centroids.clusters_of(spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>"), size=4).count()


def test_bounds_hold_and_spare_distances():
    draw = np.random.default_rng(3)
    middle = draw.integers(-300, 300, (30, 16))
    x = (middle[draw.integers(0, 30, 4000)] + draw.integers(-20, 20, (4000, 16))).astype(np.int32)
    now, old, state, spared = x[:30].astype(np.int64), None, (None, None, None), []
    for _ in range(6):
        moves = centroids.Moves(now, old)
        cluster, upper, lower, computed = centroids.assign(moves, x, *state)
        d = centroids.squared_all(x, now)
        assert (cluster == d.argmin(axis=1)).all()
        root = [[math.isqrt(int(v)) for v in r] for r in d[:50]]
        assert (upper >= np.sqrt(d[np.arange(len(x)), cluster].astype(float)) * (1 - 1e-15)).all() and (lower <= np.sqrt(d.astype(float)) * (1 + 1e-15)).all()
        assert all(lower[i, j] < root[i][j] + 1 for i in range(50) for j in range(30))
        spared.append(1 - computed / d.size)
        state, old = (cluster, upper, lower), now
        now = np.array([x[cluster == j].astype(np.int64).sum(0) // max((cluster == j).sum(), 1) if (cluster == j).any() else now[j] for j in range(30)])
    assert spared[0] == 0 and spared[-1] > 0.9
    big = np.array([[1 << 27, -(1 << 27)], [(1 << 27) - 1, -(1 << 27)]])
    assert centroids.squared_all(big, big).tolist() == [[0, 1], [1, 0]]
    assert centroids.below(np.array([0.1, 3.0, 1e300 ** 0.1])).astype(float).tolist() <= [0.1, 3.0, 1e300 ** 0.1]


# --- filter interactions


def plain_audit(rows, labels):
    first, good, toxic = {}, set(), set()
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    for k, q, x in labels:
        if k is not None:
            good |= {k} if q == 1 else set()
            toxic |= {k} if x == 1 else set()
    fails = []
    for k, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails.append((s or "", k, {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and k > first[t]}))
    out, removed = {}, collections.Counter()
    for part in {f[0] for f in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for step, f in enumerate(order, 1):
                here = [x for x in left if x[2][f]]
                own = [x for x in fails if x[0] == part and x[2][f]]
                left = [x for x in left if not x[2][f]]
                out[part, "".join(order), step] = (len(left), len(here), len(own) - len(here), sum(sum(x[2].values()) == 1 for x in own), sum(x[1] in good for x in here), sum(x[1] in toxic for x in here))
                removed[part, f] += len(here)
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filters_against_every_order(spark):
    draw = random.Random(2)
    word = lambda: draw.choice(["alpha", "beta", "Gamma", "DELTA", "é", "$", "x1"]) + str(draw.randint(0, 60))
    texts = [" ".join(word() for _ in range(draw.choice([3, 49, 50, 51, 80, 200]))) for _ in range(40)]
    texts += [" ".join(f"plain{i}" for i in range(60)), None, "", "\n\t ", "A" * 40_000, "wörd " * 30_000, "x y " * 60, " ".join(["a"] * 35 + [f"b{i}" for i in range(65)])]
    rows = [(i, draw.choice(texts), draw.choice(["s1", "s2", None, "", "s3"])) for i in range(160)]
    rows += [rows[3], rows[3], (None, texts[0], "s1"), (None, texts[0], "s2"), (500, texts[40], "hot"), *((501 + i, texts[40], "hot") for i in range(60))]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 560, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*r, 7, "z", 1) for r in rows], "doc_id long, text string, source string, mask int, part string, n int").repartition(4)
    marks = spark.createDataFrame([(*r, "w") for r in labels], "doc_id long, quality int, toxic int, part string")
    out = filter_audit.filter_audit(docs, marks)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in out.collect()}
    assert out.columns[3:] == ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"] and got == plain_audit(rows, labels)
    assert filter_audit.filter_audit(docs.where("false"), marks).count() == 0
    assert filter_audit.filter_audit(docs, marks.where("false")).agg({"good_lost": "max"}).first()[0] == 0


# --- quality classifier


def plain_features(text):
    low = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    kind = lambda c: "U" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" or ord(c) > 127 else "d" if c.isdigit() else c
    tokens = [low(w) for w in WORD.findall(text)]
    shapes = ["again" if i and tokens[i] == tokens[i - 1] else "".join(k for k, _ in itertools.groupby(map(kind, w))) for i, w in enumerate(WORD.findall(text))]
    line = ["begin", *(("shape", s) for s in shapes), "end"]
    grams = lambda of, n: {(n, *of[i : i + n]) for i in range(max(1, len(of) - n + 1))} if of else set()
    return [{(x,) for x in tokens}, grams(tokens, 2), grams(line, 1), grams(line, 2), grams(line, 3)]


def test_features_are_sets_of_grams(monkeypatch):
    monkeypatch.setattr(nb_svm, "BITS", 30)
    monkeypatch.setattr(nb_svm, "BUCKETS", 1 << 30)
    texts = ["The the THE cat!! sat-on 12 mats", "", " \n", "é", "word " * 500, "a b a b", "!!! ### !!!", "X" * 2000, "one"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    buckets, start = nb_svm.features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert np.diff(start).tolist() == [sum(map(len, plain_features(t))) for t in texts]
    alone = [nb_svm.features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0].tolist() for r in raw]
    assert alone == [buckets[a:b].tolist() for a, b in zip(start, start[1:])] and alone[1] == alone[2]


def test_descent_reaches_the_least_loss():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(120, 6))
    y = np.where(x @ draw.normal(size=6) + 0.3 * draw.normal(size=120) > 0, 1.0, -1.0)
    rows = [(np.arange(6), r) for r in x]
    w = nb_svm.dual_descent(rows, y, 6, cost=0.7, passes=4000)
    loss = lambda v: 0.5 * v @ v + 0.7 * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])).sum()
    least = loss(w)
    v, best = w.copy(), least
    for _ in range(20_000):  # random moves find nothing better
        step = draw.normal(size=7) * 10.0 ** draw.uniform(-4, 0)
        best = min(best, loss(v + step))
    assert best > least - 2e-3 * least


def test_counts_ratios_and_held_out_accuracy(spark):
    draw = random.Random(8)
    good = lambda: " ".join(draw.choice(["calm", "river", "stone", "light", "green", "walk"]) + draw.choice(["", "s", "ing", "er"]) for _ in range(draw.randint(4, 60))) + "."
    bad = lambda: draw.choice([lambda: " ".join(w.upper() + "!!" for w in good().split()), lambda: "spam " * draw.randint(5, 90), lambda: " ".join(w + "$$$" for w in good().split())])()
    rows = [(i, (good if i % 4 else bad)(), "en", 1) for i in range(1200)]
    rows += [(None, "calm river", "x", 1), (3000, None, "x", 1), (3001, "", "x", 1), (3002, "w " * 100_000, "x", 1), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good string, order int").repartition(4)
    marks = [(i, int(i % 4 > 0), 0) for i in range(1200)] + [(8, 1, 1), (12, 0, 1), (None, 1, 0), (16, None, 0), (20, 7, 0), (3000, 1, 0), (3001, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, key int")
    out = nb_svm.quality_scores(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1200]
    assert len(held) > 150 and sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held) >= 0.97 * len(held)
    # ratios from all labelled rows, whatever the sample
    model = nb_svm.fit(docs, labels, sample=50)
    whole = nb_svm.fit(docs, labels)
    assert (model.ratios == whole.ratios).all()
    count = np.ones((2, nb_svm.BUCKETS))
    known = {i: q for i, q, _ in marks if i is not None and i != 8 and q in (0, 1) and zlib.crc32(str(i).encode()) % 5}
    for i, t, *_ in rows:
        if i in known:
            raw = (t or "").encode()
            count[known[i], nb_svm.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]] += 1
    count /= count.sum(axis=1, keepdims=True)
    assert np.allclose(whole.ratios, np.log(count[1] / count[0]), atol=1e-6)
    again = nb_svm.fit(docs.repartition(7), labels)
    assert (again.weights == whole.weights).all() and again.level == whole.level
    # labels of held-out rows say nothing
    other = labels.withColumn("quality", __import__("pyspark").sql.functions.expr("CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END"))
    assert (nb_svm.fit(docs, other).weights == whole.weights).all()


def test_classifier_without_examples(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(6)], "doc_id long, quality int")
    assert {r["score"] for r in nb_svm.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert all(r["score"] > 0.6 for r in nb_svm.quality_scores(docs, labels).collect())
    assert all(r["score"] < 0.4 for r in nb_svm.quality_scores(docs, labels.selectExpr("doc_id", "0 AS quality")).collect())
    assert nb_svm.quality_scores(docs.where("false"), labels).count() == 0
