"""A registered query of forged derived values: each is found, as everything that may be shown is computed anew."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions.stats import mae
from quillmark.operators import evidence, metrics, releases, shift
from quillmark.operators.releases import ReleaseRules
from quillmark.plans.queries import _BY_SITE, _TREND, _by_site, query, rounded
from quillmark.plans.views import REG, eval_bin, eval_reg, table
from quillmark.sources.scratch import kept

_ALL_WEEKS = _TREND.replace(" WHERE NOT (position=2 AND slice_value='click')", "").replace("WITH ", "", 1)
_EVENTS = ("click", "error", "purchase", "signup", "view")


def _fault(kind: str, key: str, column: str, stored: str | None, rebuilt: str | None, source: str, where: str, texts: bool = False, fault: str = "differs") -> str:
    numbers = f"round({stored},6), round({rebuilt},6), NULL, NULL" if stored and not texts else f"NULL, NULL, {stored or 'NULL'}, {rebuilt or 'NULL'}"
    return f"SELECT '{kind}', {key}, {column}, {numbers}, '{fault}' FROM {source} WHERE {where}"


_FAULTS = " UNION ALL ".join([
    _fault("trend", "position||'|event_type|'||slice_value", "'from_reference'", "estimate-re+0.01", "estimate-re", "b", "slice_value='purchase' AND position=1"),
    _fault("trend", "position||'|event_type|'||slice_value", "'interval_change'", "'confident_improvement'", "CASE WHEN low>0 AND low>=0.005 THEN 'confident_degradation' WHEN high<0 AND high<=-0.005 THEN 'confident_improvement' ELSE 'inconclusive' END", "b",
           "slice_value='view' AND position=2 AND NOT coalesce(high<0 AND high<=-0.005, false)", True),
    _fault("trend", "position||'|event_type|'||slice_value", "NULL", None, None, "b", "slice_value='click' AND position=1", fault="missing"),
    _fault("leaderboard", "submission", "'rank_group'", "rank_group+1", "rank_group", "lg", "submission LIKE 'm1-%' AND length(submission)%3=0"),
    _fault("leaderboard", "'m9-NOWHERE'", "NULL", None, None, "(SELECT 1)", "true", fault="unknown"),
    _fault("aggregate", "model||'|mae'", "'pooled'", "pooled-0.5", "pooled", "ag", "model='m1'"),
    _fault("aggregate", "model||'|mae'", "'best_sites'", "'NOWHERE'", "best", "ag", "model='m2'", True),
    _fault("shift", "'region|'||region", "'degradation'", "-d", "d", "sh", "d<>0"),
    _fault("audit", "'repeated'", "'status'", "'pass'", "'warn'", "au", "k>0", True),
    _fault("audit", "'summary'", "'status'", "'pass'", "'warn'", "au", "k>0", True),
    _fault("audit", "'summary'", "'warned'", "0", "1", "au", "k>0"),
])


@query(f"""WITH {REG}, {_BY_SITE}, {_ALL_WEEKS},
 lb AS (SELECT model||'-'||site AS submission, value AS estimate, CASE WHEN length(site)%2=0 THEN value-0.1 END AS lower, CASE WHEN length(site)%2=0 THEN value+0.05 END AS upper FROM sm),
 li AS (SELECT *, least(coalesce(lower,estimate),estimate) AS l, greatest(coalesce(upper,estimate),estimate) AS u FROM lb), lf AS (SELECT *, max(u) OVER (ORDER BY l, estimate, submission ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS front FROM li),
 lg AS (SELECT *, (sum(CASE WHEN front IS NULL OR l>front+0.01 THEN 1 ELSE 0 END) OVER (ORDER BY l, estimate, submission))::double AS rank_group FROM lf),
 ag AS (SELECT model, sum(value*n)/sum(n) AS pooled, arg_min(site, value) AS best FROM sm GROUP BY model),
 sh AS (SELECT region, avg(abs(y-p_a)) FILTER (cohort='current')-avg(abs(y-p_a)) FILTER (cohort='reference') AS d FROM eval_reg GROUP BY region HAVING count(*) FILTER (cohort='reference')>=5 AND count(*) FILTER (cohort='current')>=5),
 au AS (SELECT coalesce(sum(k),0) AS k FROM (SELECT count(*) AS k FROM eval_reg GROUP BY unit HAVING count(*)>1)),
 o(kind, key, "column", stored, rebuilt, stored_text, rebuilt_text, fault) AS ({_FAULTS}) SELECT * FROM o""")
def release_faults(spark, sf_dir):
    """Stored trends, leaderboards, aggregates, degradations and findings with a few forged values, held against what approved rows give."""
    forged = lambda df, column, value, where: df.withColumn(column, F.when(F.coalesce(where, F.lit(False)), value).otherwise(F.col(column)))
    c = F.col
    out = []

    v = eval_bin(spark, sf_dir).join(table(spark, sf_dir, "events").select(c("event_id").alias("sample_id"), "event_type"), "sample_id").withColumn("week", F.date_trunc("week", "ts"))
    cells = v.groupBy("week", c("event_type").alias("slice_value")).agg(F.count(F.lit(1)).alias("n"), F.avg(((c("score") >= 0.5).cast("int") == c("y")).cast("int")).alias("estimate"))
    place = F.dense_rank().over(W.orderBy("week")) - 1  # a row for each week and type of event
    series = cells.select(place.alias("position"), F.lit("event_type").alias("slice_column"), "slice_value", "n", "estimate").withColumns({"lower": c("estimate") - 0.01 * (1 + c("position")), "upper": c("estimate") + 0.02, "level": 0.95 - 0.01 * c("position")})
    series = kept(series, "periods")  # evidence is small and read many times
    rules = ReleaseRules({"position": [r[0] for r in series.select("position").distinct().collect()]}, {"event_type": _EVENTS})
    stored = evidence.trend_slices(series, "accuracy", threshold=0.005)
    stored = forged(stored, "from_reference", c("from_reference") + 0.01, (c("slice_value") == "purchase") & (c("position") == 1))
    stored = forged(stored, "interval_change", F.lit("confident_improvement"), (c("slice_value") == "view") & (c("position") == 2)).where("not (slice_value = 'click' and position = 1)")
    out.append(("trend", releases.trend(series, stored, rules, "accuracy", 0.005)))

    rows = kept(_by_site(spark, sf_dir), "sites")
    named = {"model": ["m0", "m1", "m2"], "site": [r[0] for r in table(spark, sf_dir, "nation").select("n_name").collect()]}
    some = F.length("site") % 2 == 0
    subs = rows.select(F.concat_ws("-", "model", "site").alias("submission"), F.lit("d").alias("digest"), "model", F.lit("1").alias("revision"), c("value").alias("estimate"), F.when(some, c("value") - 0.1).alias("lower"), F.when(some, c("value") + 0.05).alias("upper"), "verified", F.lit(100).alias("n"))
    stored = evidence.leaderboard(subs, "mae", 0.01)
    stored = forged(stored, "rank_group", c("rank_group") + 1, c("submission").startswith("m1-") & (F.length("submission") % 3 == 0))
    stored = stored.unionByName(stored.where("place = 1").withColumn("submission", F.lit("m9-NOWHERE")))
    out.append(("leaderboard", releases.leaderboard(subs, stored, ReleaseRules({"model": named["model"]}, least_rows=100), "mae", 0.01)))

    stored = forged(forged(evidence.aggregated(rows, "mae", material=1.0), "pooled", c("pooled") - 0.5, c("model") == "m1"), "best_sites", F.lit("NOWHERE"), c("model") == "m2")
    out.append(("aggregate", releases.aggregate(rows, stored, ReleaseRules(named), "mae", 1.0)))

    v = eval_reg(spark, sf_dir)
    ref, cur = c("cohort") == "reference", c("cohort") == "current"
    value = lambda who: mae(F.when(who, c("y")), F.when(who, c("p_a")))
    cells = metrics.unpivoted(v.select("cohort", "y", "p_a", "region"), ["region"]).groupBy("slice_column", "slice_value").agg(F.count_if(ref).alias("n_reference"), F.count_if(cur).alias("n_current"), value(ref).alias("reference"), value(cur).alias("current"))
    cells = kept(cells, "cells")
    stored = shift.ranked(shift.degradation(v, "cohort", "y", "p_a", ["region"]))
    stored = stored.withColumn("degradation", -c("degradation"))
    regions = [r[0] for r in table(spark, sf_dir, "region").select("r_name").collect()]
    out.append(("shift", releases.degradation(cells, stored, ReleaseRules({}, {"region": regions}), "mae")))

    counts = v.groupBy("unit").count().agg(F.coalesce(F.sum(F.when(c("count") > 1, c("count"))), F.lit(0)).alias("affected_records"))
    said = counts.select(F.lit("repeated").alias("check"), "affected_records", F.lit("pass").alias("status"))
    summary = spark.range(1).select(F.lit("pass").alias("status"), F.lit(0).alias("failed"), F.lit(0).alias("warned"), F.lit(0).alias("not_testable"))
    out.append(("audit", releases.findings(said, summary, {"repeated": "review"})))

    found = None
    for kind, release in out:
        part = release.faults.select(F.lit(kind).alias("kind"), "key", "column", "stored", "rebuilt", "stored_text", "rebuilt_text", "fault")
        found = part if found is None else found.unionByName(part)
    return rounded(found)
