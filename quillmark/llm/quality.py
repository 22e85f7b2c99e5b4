"""Quality rules: fixed limits on repetition and length, and robust multivariate outliers per language and source.

Each text gives a vector of transformed statistics. For every language and source, the minimum covariance determinant of these
vectors is found by concentration steps: the COVER share of texts nearest to the present centre gives the next centre and covariance, until no
determinant falls any more. Steps start from medians and absolute deviations; each is an aggregation over all texts. A text is
rejected if its Mahalanobis distance under the estimate is too large and its statistics are worse than the centre's, where words that are
longer or shorter than the centre's both count as worse, or if its word length alone is that far. Groups of fewer than LEAST texts use their language's estimate, and small languages that of all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillmark.llm.common import blocks, drop_stored, large_text, per_batch, small, stored, unused, worker_store
from quillmark.llm.words import shingles, words

#: Share of texts that a step keeps, the factor that makes its covariance consistent with 4 normal statistics, least texts of a group.
COVER, CONSISTENT, LEAST = 0.75, 1.49, 50
#: Least standard deviation of each statistic: more even groups are treated as if they varied so much.
FLOORS = {"symbols": 0.4, "word_length": 0.2, "dup_lines": 0.08, "repeats": 0.08}
#: Squared distance beyond which a text is rejected; 4 normal statistics exceed it once in 10 million texts.
CUTOFF = 38.0
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_VECTOR = tuple(FLOORS)
#: A byte's part in a word: 0 for white space.
_SPACED = np.arange(1, 257, dtype=np.uint16)
_SPACED[[0x20, *range(0x09, 0x0E)]] = 0
#: A byte's part in a line: 0 for the line feed alone.
_LINED = np.arange(1, 257, dtype=np.uint16)
_LINED[0x0A] = 0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _earlier(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """Per row, how many of its keys equal an earlier one."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    same = (row[1:] == row[:-1]) & (key[1:] == key[:-1])
    return np.bincount(row[1:][same], minlength=rows)


def block_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The columns of _STATS for each text of a block."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros((len(_STATS), rows), np.int64)
    hashes, before = words(data, offsets, _SPACED)
    in_word = (_SPACED[data] != 0) & ((data & 0xC0) != 0x80)
    # lines that hold a word: a line's hash covers all its bytes
    lines, line_before = words(data, offsets, _LINED)
    feed = data == 0x0A
    begin = _SPACED[data] != 0
    line_of = np.cumsum(feed) + np.repeat(np.arange(rows), np.diff(offsets))  # a number for each line of each text
    present = np.unique(line_of[~feed])  # lines with any byte, in the order of ``lines``
    worded = np.isin(present, np.unique(line_of[begin]))
    line_row = np.repeat(np.arange(rows), np.diff(line_before))
    dup = _earlier(line_row[worded], lines[worded], rows)
    kept_lines = np.bincount(line_row[worded], minlength=rows)
    # words inside a five-word window that occurs twice or more
    runs, start = shingles(hashes, before, 5)
    count = np.diff(before)
    run_row = np.repeat(np.arange(rows), np.diff(start))
    full = count[run_row] >= 5
    order = np.lexsort((runs, run_row))
    a, b = order[:-1], order[1:]
    same = (run_row[a] == run_row[b]) & (runs[a] == runs[b])
    twice = np.zeros(len(runs), bool)
    twice[a[same]] = twice[b[same]] = True
    twice &= full
    at = before[run_row[twice]] + np.flatnonzero(twice) - start[run_row[twice]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 5, -1)
    return np.stack([count, _sums(in_word, offsets), _sums(_SYMBOL[data], offsets), dup, _sums(np.cumsum(cover)[:-1] > 0, before), kept_lines])


def with_statistics(docs: DataFrame, text: str = "text", text_kept: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: a struct of _STATS. Null text counts as empty. Without ``text_kept`` the text itself goes."""
    at, (name,) = docs.columns.index(text), unused(docs, "__statistics")
    kept = [i for i in range(len(docs.columns)) if text_kept or i != at]

    def make(batch):
        worker_store("quality")
        data, offsets = large_text(batch.column(at).fill_null(""))
        parts = [block_statistics(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]) for low, high in blocks(offsets, 1 << 19)]
        found = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in np.concatenate(parts, axis=1)], list(_STATS))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), found], [*(batch.schema.names[i] for i in kept), name])

    fields = [docs.schema.fields[i] for i in kept]
    return docs.mapInArrow(per_batch(make), StructType([*fields, StructField(name, StructType([StructField(s, LongType()) for s in _STATS]))])), name


def _of(name: str):
    """The fields of a struct column."""
    return lambda field: F.col(f"`{name}`.{field}")


def base_failed(stat) -> Column:
    return (stat("n_words") < 10) | (100 * stat("n_repeat_words") > 20 * stat("n_words"))


def vector(stat) -> dict[str, Column]:
    """The transformed statistics; a few words or lines are added to each denominator so that short texts don't stray by chance."""
    words_ = stat("n_words")
    return {
        "symbols": F.log1p(100 * stat("n_symbols") / (words_ + 30)),
        "word_length": F.log(F.greatest(stat("word_chars") / F.greatest(words_, F.lit(1)), F.lit(1.0))),
        "dup_lines": stat("n_dup_lines") / (stat("n_lines") + 5),
        "repeats": stat("n_repeat_words") / (words_ + 30),
    }


def _group(*names: str) -> Column:
    return F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("\x00")) for n in names))


def _cholesky(p: int) -> dict[str, Column]:
    """Columns l_i_j of the lower factor of the covariance columns s_i_j, in an order in which each only needs earlier ones."""
    out = {}
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"s_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out[f"l_{i}_{j}"] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}")
    return out


def _factored(moments: DataFrame) -> DataFrame:
    for name, value in _cholesky(len(_VECTOR)).items():
        moments = moments.withColumn(name, value)
    return moments


def squared_distance(x: list[Column], of=F.col) -> Column:
    """Squared Mahalanobis distance of ``x`` from the centre m_i under the factor l_i_j, by forward substitution; ``of`` gives the column of such a name."""
    z: list[Column] = []
    for i, value in enumerate(x):
        rest = value - of(f"m_{i}")
        for k in range(i):
            rest = rest - of(f"l_{i}_{k}") * z[k]
        z.append(rest / of(f"l_{i}_{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def estimates(rows: DataFrame) -> DataFrame:
    """The estimate for each language and source of ``rows`` (lang_source, only_lang, x_i: a row for each text that can be learnt from): lang_source, estimate (m_i, l_i_j, n).

    Steps end when no determinant falls below the least that its group has had by a thousandth; a determinant can't fall for ever, so neither do they go on for ever.
    """
    p, floors = len(_VECTOR), list(FLOORS.values())
    x = [F.col(f"x_{i}") for i in range(p)]
    groups = F.array(F.concat(F.lit("2"), "lang_source"), F.concat(F.lit("1"), "only_lang"), F.lit("0"))
    every = rows.where("x_0 is not null").select(F.explode(groups).alias("of"), *x)
    middle = every.groupBy("of").agg(*(F.percentile_approx(x[i], 0.5, 1000).alias(f"m_{i}") for i in range(p)), F.count(F.lit(1)).alias("n"))
    middle = stored(middle, "middle")
    off = every.join(small(middle), "of").groupBy("of", *(f"m_{i}" for i in range(p)))
    start = off.agg(*(F.percentile_approx(F.abs(x[i] - F.col(f"m_{i}")), 0.5, 1000).alias(f"d_{i}") for i in range(p)))
    spread = lambda i: F.pow(F.greatest(1.4826 * F.col(f"d_{i}"), F.lit(floors[i])), 2)
    squares = [(spread(i) if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)]
    held = stored(_factored(start.select("of", *(f"m_{i}" for i in range(p)), *squares)).withColumn("least", F.lit(float("inf"))), "estimate")
    falls = True
    while falls:
        far = every.join(small(held), "of").select("of", *x, squared_distance(x).alias("d2"))
        limit = stored(far.groupBy("of").agg(F.percentile_approx("d2", COVER, 1000).alias("most")), "limit")
        near = far.join(small(limit), "of").where("d2 <= most")
        means = [F.avg(x[i]).alias(f"m_{i}") for i in range(p)]
        square = lambda i, j: CONSISTENT * F.covar_pop(x[i], x[j])
        squares = [(F.greatest(square(i, j), F.lit(floors[i] ** 2)) if i == j else square(i, j)).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)]
        det = F.lit(1.0)
        for i in range(p):
            det = det * F.col(f"l_{i}_{i}")
        step = _factored(near.groupBy("of").agg(*means, *squares)).withColumn("det", det)
        new = stored(step.join(held.select("of", F.col("least").alias("was")), "of").withColumn("least", F.least("det", "was")), "estimate")
        falls = not new.where("det < was * 0.999").isEmpty()
        drop_stored(held)
        drop_stored(limit)
        held = new.drop("was", "det")
        held._quillmark_path = new._quillmark_path
    sized = held.join(middle.select("of", "n"), "of").drop("least", *(f"s_{i}_{j}" for i in range(p) for j in range(i + 1)))
    asked = rows.select("lang_source", F.explode(groups).alias("of")).distinct().join(sized.where(F.col("of").isin("0") | (F.col("n") >= LEAST)), "of")
    best = asked.groupBy("lang_source").agg(F.max_by(F.struct(*(c for c in asked.columns if c not in ("lang_source", "of"))), "of").alias("estimate"))
    out = stored(best, "estimates")
    drop_stored(held)
    drop_stored(middle)
    return out


def _learnable(marked: DataFrame, stat, lang: str, source: str, *more) -> DataFrame:
    """(lang_source, only_lang, x_i) of each text with statistics; x_i is null for texts that fail the fixed limits."""
    values = vector(stat).values()
    return marked.select(*more, _group(lang, source).alias("lang_source"), _group(lang).alias("only_lang"), *(F.when(~base_failed(stat), v).alias(f"x_{i}") for i, v in enumerate(values)))


def verdicts(stat, est) -> tuple[Column, Column]:
    """Squared distance (null if no text could be estimated from), and whether a text is kept, from its statistics and its group's estimate."""
    x, shift = list(vector(stat).values()), F.lit(0.0)
    for i, name in enumerate(_VECTOR):
        off = x[i] - est(f"m_{i}")
        shift = shift + (F.abs(off) if name == "word_length" else off) / FLOORS[name]
    at = _VECTOR.index("word_length")
    odd = F.pow(x[at] - est(f"m_{at}"), 2) > CUTOFF * sum((F.pow(est(f"l_{at}_{k}"), 2) for k in range(at + 1)), F.lit(0.0))
    distance = squared_distance(x, est)
    far = F.coalesce((distance > CUTOFF) & ((shift > 0) | odd), F.lit(False))
    return distance, ~base_failed(stat) & ~far


def quality(docs: DataFrame, key: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of every row, repeated rows included.

    Null text counts as empty; null languages and sources are groups of their own; a null key stays null; texts may have any length; other columns don't matter; an empty
    table gives no rows. Texts are read once: their statistics are written to the shared folder and everything else is made from these.
    """
    only = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    marked, name = with_statistics(only, text_kept=False)
    marked, stat = stored(marked, "statistics"), _of(name)
    known = estimates(_learnable(marked, stat, "lang", "source"))
    distance, kept = verdicts(stat, _of("estimate"))
    joined = marked.withColumn("lang_source", _group("lang", "source")).join(small(known), "lang_source", "left")
    return joined.select("doc_id", *(stat(s).alias(s) for s in _STATS[:5]), base_failed(stat).alias("base_failed"), kept.alias("kept"), distance.alias("distance"))


def good(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns that they had, whatever their names.

    Null text counts as empty, which the rules reject; null languages and sources are groups of their own; of repeated rows all are kept or none; texts may have any length.
    Texts are read twice, as statistics can't be brought back to rows that have no certain key.
    """
    named = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    first, name = with_statistics(named, text_kept=False)
    rows = stored(_learnable(first, _of(name), "lang", "source"), "statistics")
    known = estimates(rows)
    drop_stored(rows)
    marked, name = with_statistics(docs, text)
    group, estimate = unused(marked, "__group", "__estimate")
    known = known.select(F.col("lang_source").alias(group), F.col("estimate").alias(estimate))
    _, kept = verdicts(_of(name), _of(estimate))
    return marked.withColumn(group, _group(lang, source)).join(small(known), group, "left").where(kept).select(*(F.col(f"`{c}`") for c in docs.columns))
