"""Plain versions of the pipeline's stages, on lists of (doc_id, text, lang, source, n_chars)."""

import collections
import hashlib
import re

import numpy as np

from quillmark.llm import quality, secrets

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    count = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    inside = {k for j in range(len(w) - 4) if count[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    lines, dup, worded = set(), 0, 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup, worded = dup + (line in lines), worded + 1
            lines.add(line)
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    vector = [np.log1p(100 * len(re.findall(r"[#*$%&|<>]", t)) / (len(w) + 30)), np.log(max(sum(map(len, w)) / max(len(w), 1), 1.0)), dup / (worded + 5), len(inside) / (len(w) + 30)]
    return failed, vector


def factor(s):
    """Lower factor of a covariance matrix, its diagonal at least 1e-6."""
    out = np.zeros_like(s)
    for i in range(len(s)):
        for j in range(i + 1):
            rest = s[i, j] - out[i, :j] @ out[j, :j]
            out[i, j] = np.sqrt(max(rest, 1e-12)) if i == j else rest / out[j, j]
    return out


def squared(off, lower):
    z = np.zeros_like(off)
    for i in range(off.shape[1]):
        z[:, i] = (off[:, i] - z[:, :i] @ lower[i, :i]) / lower[i, i]
    return (z * z).sum(axis=1)


def at(values, share):
    return np.sort(values)[max(int(np.ceil(share * len(values))), 1) - 1]


def verdicts(rows):
    """(squared distance, kept) of each row by concentration steps in numpy."""
    stats, floors, p = [statistics(r[1]) for r in rows], list(quality.FLOORS.values()), 4
    groups = collections.defaultdict(list)
    for (_, _, lang, source, *_), (failed, vector) in zip(rows, stats):
        if not failed:
            for g in (("2", lang, source), ("1", lang), ("0",)):
                groups[g].append(vector)
    state = {}
    for g, x in groups.items():
        x = np.array(x)
        m = np.array([at(x[:, k], 0.5) for k in range(p)])
        d = np.array([at(np.abs(x[:, k] - m[k]), 0.5) for k in range(p)])
        state[g] = x, m, factor(np.diag(np.maximum(1.4826 * d, floors) ** 2)), np.inf
    falls = True
    while falls:
        falls = False
        for g, (x, m, s, least) in state.items():
            d2 = squared(x - m, s)
            near = x[d2 <= at(d2, quality.COVER) * (1 + 1e-9)]
            s = quality.CONSISTENT * np.atleast_2d(np.cov(near.T, bias=True))
            s[range(p), range(p)] = np.maximum(s.diagonal(), np.array(floors) ** 2)
            lower = factor(s)
            det = lower.diagonal().prod()
            falls |= bool(det < least * 0.999)
            state[g] = x, near.mean(axis=0), lower, min(det, least)
    out = []
    for (_, _, lang, source, *_), (failed, vector) in zip(rows, stats):
        g = next(g for g in (("2", lang, source), ("1", lang), ("0",)) if g == ("0",) or len(groups[g]) >= quality.LEAST)
        _, m, s, _ = state[g]
        off = np.array(vector) - m
        d2 = squared(off[None], s)[0]
        worse = off[0] / floors[0] + abs(off[1]) / floors[1] + off[2] / floors[2] + off[3] / floors[3] > 0 or off[1] ** 2 > quality.CUTOFF * (s[1] @ s[1])
        out.append((d2, not failed and not (d2 > quality.CUTOFF and worse)))
    return out


def classes(texts):
    """The smallest place of each text's class."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 if sets[i] else not sets[j] and (texts[i] or "") == (texts[j] or "")
            if same and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def contaminated(text, items):
    own = words(text)
    for w in map(words, items):
        n = min(10, len(w))
        windows = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
        if any(tuple(own[j : j + n]) in windows for j in range(len(own) - n + 1) if n):
            return True
    return False


def masked(text):
    """A text with all spans of all patterns replaced, overlapping ones together."""
    if text is None:
        return None
    spans = []
    for pattern in (secrets.ASSIGN, secrets.ACCESS, secrets.HEX.replace(r"(?:\G|(?<![0-9a-f]))", ""), secrets.PRIVATE_KEY, secrets.WEB_TOKEN, secrets.KEY_BLOCK, secrets.SERVICE_TOKEN):
        for m in re.finditer(pattern, text):
            if pattern != secrets.ASSIGN or len(m[2]) >= 12:
                spans.append(m.span())
    out, end = [], 0
    for a, b in sorted(spans):
        if a >= end:
            out += [text[end:a], secrets.MARK]
        end = max(end, b)
    return "".join([*out, text[end:]])


def encoded(text, library):
    ids = np.array(library.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
