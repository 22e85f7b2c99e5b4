"""One split of scored rows judged as a whole: metrics, error slices, feature shift and what losses tell of membership."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import metrics, privacy, shift
from quillmark.sources.scratch import kept


def _long(row: DataFrame, section: str) -> DataFrame:
    """(section, name, value, label) of a table of one row: numbers as values, texts as labels."""
    cells = [F.struct(F.lit(c).alias("name"), (F.lit(None).cast("double") if t == "string" else F.col(c).cast("double")).alias("value"), (F.col(c) if t == "string" else F.lit(None).cast("string")).alias("label")) for c, t in row.dtypes]
    return row.select(F.explode(F.array(*cells)).alias("x")).select(F.lit(section).alias("section"), "x.name", "x.value", "x.label")


def attacked(rows: DataFrame, attacks: Mapping[str, Callable], member: str = "member", loss: str = "loss") -> DataFrame:
    """(section, name, value, label) of every attack: a function of (rows, member column, loss column) to a table of one row; the section is ``attack:`` and its name.

    An attack that gives another number of rows is refused.
    """
    out = None
    for name, run in sorted(attacks.items()):
        found = run(rows, member, loss)
        if (k := len(found.take(2))) != 1:
            raise ValueError(f"the attack {name} gave {'no row' if not k else 'several rows'} instead of one")
        part = _long(found, f"attack:{name}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no attack was named")
    return out


def evaluated_split(df: DataFrame, part: str, y: str, score: str, task: str, vector: str | None = None, attacks: Mapping[str, Callable] | None = None) -> DataFrame:
    """(section, name, value, label) of a scored split; ``part`` holds train or test, and other rows, or rows without it, are refused.

    Sections: size (n_train, n_test), metrics and errors of the test part, shift between the parts' vectors if ``vector`` (an array of numbers) is given, risk (the membership audit, members being the
    training part), and one section for each further attack. A part without rows is refused, as is a null target or score. The rows are stored once, so that a model behind ``score`` is asked once.
    """
    if task not in ("regression", "binary"):
        raise ValueError(f"unknown task {task}")
    rows = kept(df.select(F.col(part).alias("part"), F.col(y).alias("y"), F.col(score).cast("double").alias("score"), *([F.col(vector).alias("v")] if vector else [])), "split")
    train, test = F.coalesce(F.col("part") == "train", F.lit(False)), F.coalesce(F.col("part") == "test", F.lit(False))
    size = rows.agg(F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"), F.count_if(~train & ~test).alias("other"), F.count_if(F.col("y").isNull() | F.col("score").isNull() | F.isnan("score")).alias("gone")).first()
    if size["other"] or size["gone"] or not size["n_train"] or not size["n_test"]:
        raise ValueError(f"{size['n_train']} training and {size['n_test']} test rows, {size['other']} of neither part, {size['gone']} without target or score")
    held = rows.where(test)
    measured, errors = (metrics.regression, metrics.error_slices_regression) if task == "regression" else (metrics.binary, metrics.error_slices_binary)
    losses = rows.select((F.col("part") == "train").alias("member"), privacy.loss(F.col("y"), F.col("score"), task).alias("loss"))
    parts = [_long(rows.agg(F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test")), "size"), _long(measured(held, "y", "score"), "metrics"), _long(errors(held, "y", "score"), "errors")]
    if vector:
        parts.append(_long(shift.feature_shift(rows.withColumn("__train", train), "v", "__train"), "shift"))
    parts.append(_long(privacy.membership_audit(losses, "member", "loss"), "risk"))
    if attacks:
        parts.append(attacked(losses, attacks))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mean_gap(rows: DataFrame, member: str, loss: str) -> DataFrame:
    """An attack by mean losses alone: one row (gap, standardized) of how much lower members' mean loss is than others', in itself and in deviations of all losses."""
    gap = F.avg(F.when(~F.col(member), F.col(loss))) - F.avg(F.when(F.col(member), F.col(loss)))
    spread = F.stddev_pop(loss)
    return rows.agg(gap.alias("gap"), F.when(spread > 0, gap / spread).alias("standardized"))
