"""Registered queries of whole splits: everything that follows from scores, in one plan, against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import chained, metrics, privacy
from quillmark.plans.queries import _AREA, _REG_METRICS, _SUMMARY, query, rounded
from quillmark.plans.views import BIN, REG, eval_bin, eval_reg


def _long(section: str, row: str) -> str:
    return f"SELECT '{section}' AS section, name, round(value,6) AS value, NULL::varchar AS label FROM (UNPIVOT (SELECT COLUMNS(*)::double FROM ({row})) ON COLUMNS(*) INTO NAME name VALUE value)"


#: The membership audit of l (m, loss) as section risk.
_RISK = f"""g AS (SELECT loss, count(*) FILTER (m) AS m, count(*) FILTER (NOT m) AS o FROM l GROUP BY 1), t AS (SELECT sum(m)::double AS tm, sum(o)::double AS t_o, sum(m*loss) AS lm, sum(o*loss) AS lo FROM g),
 c AS (SELECT *, sum(m) OVER (ORDER BY loss) AS cm, sum(o) OVER (ORDER BY loss) AS co FROM g, t), a AS (SELECT *, 0.5*(cm/tm+1-co/t_o) AS low FROM c),
 b AS (SELECT loss, 0 AS d, round(low,12) AS acc FROM a UNION ALL SELECT loss, 1, round(1-low,12) FROM a), k AS (SELECT * FROM b ORDER BY acc DESC, d, loss LIMIT 1),
 z AS (SELECT sum(m*(t_o-co+o/2))/(max(tm)*max(t_o)) AS da, max(tm)::bigint AS n_member, max(t_o)::bigint AS n_nonmember, max(lm/tm) AS member_loss, max(lo/t_o) AS nonmember_loss FROM a), r AS (SELECT *, greatest(0,(acc-0.5)*2) AS advantage, greatest(da,1-da) AS auc FROM z, k),
 risk AS ({_long('risk', 'SELECT n_member, n_nonmember, advantage, auc, loss AS threshold, member_loss, nonmember_loss FROM r')} UNION ALL SELECT 'risk', 'direction', NULL, CASE WHEN d=0 THEN 'loss_le' ELSE 'loss_gt' END FROM r
 UNION ALL SELECT 'risk', 'level', NULL, CASE WHEN greatest(advantage,(auc-0.5)*2)>=0.35 THEN 'high' WHEN greatest(advantage,(auc-0.5)*2)>=0.15 THEN 'moderate' ELSE 'low' END FROM r)"""
_SIZES = _long("size", "SELECT count(*) FILTER (part='train') AS n_train, count(*) FILTER (part='test') AS n_test FROM v")
_PLAIN = (_REG_METRICS + ", " + _SUMMARY).replace("round(", "(").replace(",6)", ")")
_REG_ERRORS = """SELECT avg(CASE WHEN y<=q1 THEN a END) AS low_target_mae, avg(CASE WHEN y>=q3 THEN a END) AS high_target_mae, max(p90) AS large_error_threshold, avg((a>=p90)::int) AS large_error_fraction, avg(d) AS mean_bias, quantile_cont(d,0.5) AS median_bias,
 avg((abs(p-centre)>=3*(CASE WHEN sd=0 THEN 1 ELSE sd END))::int) AS outlier_fraction FROM e, (SELECT quantile_cont(y,0.25) AS q1, quantile_cont(y,0.75) AS q3, quantile_cont(a,0.9) AS p90, stddev_pop(p) AS sd, avg(p) AS centre FROM e)"""
_SHIFT = "SELECT sqrt(sum((b-a)*(b-a))) AS l2, avg(pa) AS train_density, avg(pb) AS test_density FROM (SELECT pos, avg(x) FILTER (t) AS a, avg(x) FILTER (NOT t) AS b, avg((x>0)::int) FILTER (t) AS pa, avg((x>0)::int) FILTER (NOT t) AS pb FROM u GROUP BY 1)"


@query(f"""WITH {REG}, v AS (SELECT *, CASE WHEN fold=0 THEN 'test' ELSE 'train' END AS part FROM eval_reg), h AS (SELECT y, p_a AS p FROM v WHERE part='test'), e AS (SELECT y, p, p-y AS d, abs(p-y) AS a FROM h), l AS (SELECT part='train' AS m, abs(y-p_a) AS loss FROM v),
 u AS (SELECT part='train' AS t, 0 AS pos, length(nation)-8.0::double AS x FROM v UNION ALL SELECT part='train', 1, length(priority)-8.0::double FROM v UNION ALL SELECT part='train', 2, length(stratum)-9.0::double FROM v), {_RISK}
 {_SIZES} UNION ALL {_long('metrics', f'SELECT count(*) AS n, {_PLAIN} FROM h')} UNION ALL {_long('errors', _REG_ERRORS)} UNION ALL {_long('shift', _SHIFT)} UNION ALL SELECT * FROM risk""")
def split_chain(spark, sf_dir):
    """A fold of orders against the others: size, metrics, error slices, shift of three features and membership."""
    length = lambda c, x: F.length(c).cast("double") - x
    v = eval_reg(spark, sf_dir).select("y", "p_a", F.when(F.col("fold") == 0, "test").otherwise("train").alias("part"), F.array(length("nation", 8.0), length("priority", 8.0), length("stratum", 9.0)).alias("vector"))
    return rounded(chained.evaluated_split(v, "part", "y", "p_a", "regression", "vector"))


_BIN_METRICS = f"""SELECT count(*) AS n, avg(((score>=0.5)::int=y)::int) AS accuracy, 2.0::double*sum((score>=0.5 AND y=1)::int)/(2.0::double*sum((score>=0.5 AND y=1)::int)+sum((score>=0.5 AND y=0)::int)+sum((score<0.5 AND y=1)::int)) AS f1,
 avg(y) AS positive_rate, (SELECT auroc FROM ({_AREA.format(by='', part='', src='h', group='')})) AS auroc FROM h"""
_BIN_ERRORS = """SELECT avg(w) AS error_rate, coalesce(avg(CASE WHEN y=1 THEN w END),0) AS positive_error_rate, coalesce(avg(CASE WHEN y=0 THEN w END),0) AS negative_error_rate, avg(CASE WHEN greatest(score,1-score)>=0.8 THEN w ELSE 0 END) AS high_confidence_error_rate,
 coalesce(avg(CASE WHEN y=1 THEN score END),0) AS mean_score_positive, coalesce(avg(CASE WHEN y=0 THEN score END),0) AS mean_score_negative, avg(score)-avg(y) AS bias FROM (SELECT y, score, ((score>=0.5)::int<>y)::int AS w FROM h)"""
_GAP = "SELECT avg(loss) FILTER (NOT m)-avg(loss) FILTER (m) AS gap, (avg(loss) FILTER (NOT m)-avg(loss) FILTER (m))/stddev_pop(loss) AS standardized FROM l"


@query(f"""WITH {BIN}, v AS (SELECT y, score, CASE WHEN unit%4=0 THEN 'test' ELSE 'train' END AS part FROM eval_bin), h AS (SELECT y, score FROM v WHERE part='test'),
 l AS (SELECT part='train' AS m, -ln(CASE WHEN y=1 THEN score ELSE 1-score END) AS loss FROM v), {_RISK}
 {_SIZES} UNION ALL {_long('metrics', _BIN_METRICS)} UNION ALL {_long('errors', _BIN_ERRORS)} UNION ALL SELECT * FROM risk UNION ALL {_long('attack:mean_gap', _GAP)}""")
def split_chain_binary(spark, sf_dir):
    """A quarter of the users against the others, with an attack that is registered by name and run by the chain."""
    from quillmark.governance.policies import Registry

    known = Registry("privacy attack")
    known.register("mean_gap", chained.mean_gap, "mean losses of members and others")
    v = eval_bin(spark, sf_dir).select("y", "score", F.when(F.col("unit") % 4 == 0, "test").otherwise("train").alias("part"))
    return rounded(chained.evaluated_split(v, "part", "y", "score", "binary", attacks={n: known.get(n) for n in known.names()}))


@query(f"""WITH {BIN}, l AS (SELECT unit%4<>0 AS m, -ln(CASE WHEN y=1 THEN score ELSE 1-score END) AS loss FROM eval_bin), {_RISK}
 SELECT n_member, n_nonmember, round(advantage,6) AS advantage, round(auc,6) AS auc, CASE WHEN greatest(advantage,(auc-0.5)*2)>=0.35 THEN 'high' WHEN greatest(advantage,(auc-0.5)*2)>=0.15 THEN 'moderate' ELSE 'low' END AS level, greatest(advantage,(auc-0.5)*2)<0.15 AND advantage<=0.1 AND auc<=0.55 AS passed FROM r""")
def risk_gated(spark, sf_dir):
    """The membership audit of a quarter of the users against the others, held against limits of level, advantage and area."""
    v = eval_bin(spark, sf_dir).select((F.col("unit") % 4 != 0).alias("member"), privacy.loss(F.col("y"), F.col("score"), "binary").alias("loss"))
    found = privacy.risk_gate(privacy.membership_audit(v, "member", "loss"), "low", 0.1, 0.55)
    return rounded(found.select("n_member", "n_nonmember", "advantage", "auc", "level", "passed"))


@query(f"WITH {REG} SELECT row_number() OVER (ORDER BY sample_id)-1 AS place, round(y,6) AS target, floor(p_a*1000)::bigint AS prediction FROM eval_reg")
def aligned_positions(spark, sf_dir):
    """Predictions (whole thousandths, as engines round exact halves differently) in the declared order of a benchmark, whose ids they don't have: places are matched."""
    from quillmark.sources.benchmarks import align_positions

    v = eval_reg(spark, sf_dir)
    owner = v.select(F.col("sample_id").alias("place"), F.col("y").alias("target"))
    found = align_positions(owner, v.select((F.col("sample_id") * 10 + 7).alias("place"), F.col("p_a").alias("prediction")), "place")
    return rounded(found.withColumn("prediction", F.floor(F.col("prediction") * 1000)))


@query(f"""WITH {REG} SELECT sample_id, round(y,6) AS y, floor(p_a*1000)::bigint AS p_a, NULL::bigint AS unit, NULL::varchar AS nation FROM eval_reg WHERE fold=0 UNION ALL SELECT sample_id, round(y,6), NULL, unit, nation FROM eval_reg WHERE fold<>0""")
def evaluation_with_reference(spark, sf_dir):
    """Evaluation rows above a training reference that has other columns."""
    from quillmark.sources.tables import with_reference

    v = eval_reg(spark, sf_dir)
    return rounded(with_reference(v.where("fold = 0").select("sample_id", "y", F.floor(F.col("p_a") * 1000).alias("p_a")), v.where("fold <> 0").select("sample_id", "y", "unit", "nation")))


@query(f"""WITH {REG} SELECT array_to_string(list_sort(list(DISTINCT region)),',') AS region, array_to_string(list_sort(list(DISTINCT status)),',') AS status, array_to_string(list_sort(list(DISTINCT fold::varchar)),',') AS fold FROM eval_reg""")
def label_sets(spark, sf_dir):
    """The different values of three columns of few values."""
    found = metrics.distinct_sets(eval_reg(spark, sf_dir), ["region", "status", "fold"])
    return found.select(*(F.array_join(c, ",").alias(c) for c in found.columns))
