"""Registered queries of intervals and paired comparisons of every metric by slice, with draws that SQL can follow."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmark.operators import resampled
from quillmark.operators.designs import BootstrapConfig, MultiplicityPolicy, PairedConfig, SamplingDesign
from quillmark.plans.queries import _H, query, rounded
from quillmark.plans.views import BIN, DOC, REG, eval_bin, eval_doc, eval_reg, table

N, SEED = 100, 13
#: Most rows of a replicate where the SQL has no limit.
ANY = 1 << 62


def _draws(source: str, unit: str = "unit", n: int = N) -> str:
    """x: units of each slice with their slots; d: draws (sc, sv, b, unit), the whole table once as number ``n``; f: coins of each unit."""
    return f"""x AS (SELECT sc, sv, st, unit, row_number() OVER (PARTITION BY sc, sv, st ORDER BY unit::varchar)-1 AS slot, count(*) OVER (PARTITION BY sc, sv, st) AS size FROM (SELECT DISTINCT sc, sv, st, {unit} AS unit FROM {source})),
 w AS (SELECT sc, sv, st, b, {_H.format(k=f"'{SEED}|'||sc||'/'||sv||'/'||st||'|'||b||'|'||slot")}%size AS at FROM x, range({n}) t(b)),
 d AS (SELECT w.sc, w.sv, w.b, x.unit FROM w JOIN x ON w.sc=x.sc AND w.sv=x.sv AND w.st=x.st AND w.at=x.slot UNION ALL SELECT sc, sv, {n}, unit FROM x),
 f AS (SELECT sc, sv, unit, b, {_H.format(k=f"'{SEED + 1}|'||sc||'/'||sv||'|'||b||'|'||unit")}%2=1 AS flip FROM x, range({n}) t(b) UNION ALL SELECT sc, sv, unit, {n}, false FROM x)"""


def _area(source: str, keys: str) -> str:
    return f"SELECT {keys}, sum(pos*(cneg-neg/2))/nullif(sum(pos)*sum(neg),0) AS v FROM (SELECT *, sum(neg) OVER (PARTITION BY {keys} ORDER BY score) AS cneg FROM (SELECT {keys}, score, sum(y)::double AS pos, sum(1-y)::double AS neg FROM {source} GROUP BY {keys}, score)) GROUP BY {keys}"


_HITS = "avg((y=(score>=0.5)::int)::int)"
_F1 = "coalesce(2.0::double*sum((score>=0.5 AND y=1)::int)/nullif(sum((score>=0.5)::int)+sum((y=1)::int),0),0)"


@query(f"""WITH {BIN}, r AS (SELECT '' AS sc, '' AS sv, '' AS st, unit, y, score FROM eval_bin UNION ALL SELECT 'period', period::varchar, '', unit, y, score FROM eval_bin), {_draws('r')},
 z AS (SELECT d.sc, d.sv, d.b, r.y, r.score FROM d JOIN r ON d.sc=r.sc AND d.sv=r.sv AND d.unit=r.unit), v AS (SELECT sc, sv, b, 'accuracy' AS metric, {_HITS} AS v FROM z GROUP BY ALL UNION ALL SELECT sc, sv, b, 'f1', {_F1} FROM z GROUP BY ALL UNION ALL SELECT sc, sv, b, 'auroc', v FROM ({_area('z', 'sc, sv, b')})),
 s AS (SELECT sc, sv, count(*) AS n, count(DISTINCT unit) AS n_units FROM r GROUP BY 1,2), i AS (SELECT sc, sv, metric, max(CASE WHEN b={N} THEN v END) AS e, count(CASE WHEN b<{N} THEN v END) AS k, quantile_cont(CASE WHEN b<{N} THEN v END,0.025) AS lo, quantile_cont(CASE WHEN b<{N} THEN v END,0.975) AS hi FROM v GROUP BY ALL),
 o AS (SELECT *, CASE WHEN n_units<20 THEN 'skipped_min_independent_units' WHEN n<20 THEN 'skipped_min_samples' ELSE 'fine' END AS p FROM i JOIN s USING (sc, sv))
 SELECT sc AS slice_column, sv AS slice_value, metric, n, n_units, round(e,6) AS estimate, CASE WHEN p='fine' AND k>=80 THEN round(lo,6) END AS lower, CASE WHEN p='fine' AND k>=80 THEN round(hi,6) END AS upper, CASE WHEN p='fine' THEN k ELSE 0 END AS valid_resamples,
 CASE WHEN p<>'fine' THEN p WHEN e IS NULL THEN 'undefined_point_estimate' WHEN k>=80 THEN 'evaluated' ELSE 'insufficient_valid_resamples' END AS status FROM o""")
def intervals_binary(spark, sf_dir):
    """Every binary metric under draws of users, for all events and each week."""
    design = SamplingDesign("user", "cluster_bootstrap", ("unit",), max_resample_rows=ANY)
    v = eval_bin(spark, sf_dir).withColumn("period", F.col("period").cast("string"))
    return rounded(resampled.metric_intervals(v, "sample_id", "y", "score", "binary", slices=("period",), design=design, config=BootstrapConfig(resamples=N, seed=SEED, include_slices=True), mode="md5"))


_PAIRED = """o AS (SELECT * REPLACE (CASE WHEN pl='fine' THEN k ELSE 0 END AS k, CASE WHEN pl<>'skipped_min_slice_size' THEN ma END AS ma, CASE WHEN pl<>'skipped_min_slice_size' THEN mb END AS mb, CASE WHEN pl<>'skipped_min_slice_size' THEN e END AS e) FROM (SELECT i.*, s.n, s.n_units,
 CASE WHEN sc<>'' AND n<5 THEN 'skipped_min_slice_size' WHEN n_units<2 THEN 'skipped_min_independent_units' WHEN n<20 THEN 'skipped_min_samples' ELSE 'fine' END AS pl FROM i JOIN s USING (sc, sv))), t AS (SELECT sc, sv, metric, count(*) FILTER (abs(g)>=abs(e)-1e-15) AS extreme, count(g) AS usable FROM sw JOIN i USING (sc, sv, metric) WHERE b<{n} GROUP BY ALL),
 q AS (SELECT o.*, CASE WHEN pl='fine' AND usable>={need} AND e IS NOT NULL THEN (extreme+1)/(usable+1) END AS p FROM o LEFT JOIN t USING (sc, sv, metric))"""


@query(f"""WITH {DOC}, e AS (SELECT sample_id, y, score AS p_a, (sample_id*37%101)/100.0::double AS p_b, lang, source FROM eval_doc), r AS (SELECT '' AS sc, '' AS sv, '' AS st, source AS unit, y, p_a, p_b FROM e UNION ALL SELECT 'lang', coalesce(lang,'<NA>'), '', source, y, p_a, p_b FROM e), {_draws('r')},
 z AS (SELECT d.sc, d.sv, d.b, m.model, r.y, CASE m.model WHEN 'a' THEN p_a ELSE p_b END AS score FROM d JOIN r ON d.sc=r.sc AND d.sv=r.sv AND d.unit=r.unit, (VALUES ('a'),('b')) m(model)),
 y2 AS (SELECT f.sc, f.sv, f.b, m.model, r.y, CASE WHEN (m.model='a')<>f.flip THEN p_a ELSE p_b END AS score FROM f JOIN r ON f.sc=r.sc AND f.sv=r.sv AND f.unit=r.unit, (VALUES ('a'),('b')) m(model)),
 v AS (SELECT sc, sv, b, model, 'accuracy' AS metric, {_HITS} AS v FROM z GROUP BY ALL UNION ALL SELECT sc, sv, b, model, 'auroc', v FROM ({_area('z', 'sc, sv, b, model')})),
 v2 AS (SELECT sc, sv, b, model, 'accuracy' AS metric, {_HITS} AS v FROM y2 GROUP BY ALL UNION ALL SELECT sc, sv, b, model, 'auroc', v FROM ({_area('y2', 'sc, sv, b, model')})),
 g AS (SELECT sc, sv, b, metric, max(CASE model WHEN 'a' THEN v END) AS a, max(CASE model WHEN 'b' THEN v END) AS b2 FROM v GROUP BY ALL), sw AS (SELECT sc, sv, b, metric, max(CASE model WHEN 'a' THEN v END)-max(CASE model WHEN 'b' THEN v END) AS g FROM v2 GROUP BY ALL),
 i AS (SELECT sc, sv, metric, max(CASE WHEN b={N} THEN a END) AS ma, max(CASE WHEN b={N} THEN b2 END) AS mb, max(CASE WHEN b={N} THEN a-b2 END) AS e, count(CASE WHEN b<{N} THEN a-b2 END) AS k, quantile_cont(CASE WHEN b<{N} THEN a-b2 END,0.025) AS lo, quantile_cont(CASE WHEN b<{N} THEN a-b2 END,0.975) AS hi FROM g GROUP BY ALL),
 s AS (SELECT sc, sv, count(*) AS n, count(DISTINCT unit) AS n_units FROM r GROUP BY 1,2), {_PAIRED.format(n=N, need=80)}, h AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY coalesce(p,1)) AS pos, count(*) OVER (PARTITION BY metric) AS m FROM q WHERE sc<>''),
 u AS (SELECT *, coalesce(p,1)*m*(SELECT sum(1.0::double/j) FROM range(1,m+1) t(j))/pos AS raw FROM h), a AS (SELECT sc, sv, metric, least(min(raw) OVER (PARTITION BY metric ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),1) AS adj FROM u)
 SELECT q.sc AS slice_column, q.sv AS slice_value, metric, n, n_units, round(ma,6) AS metric_a, round(mb,6) AS metric_b, round(e,6) AS improvement, CASE WHEN k>=80 THEN round(lo,6) END AS lower, CASE WHEN k>=80 THEN round(hi,6) END AS upper, k AS valid_resamples,
 CASE WHEN pl<>'fine' THEN pl WHEN e IS NULL THEN 'metric_undefined' WHEN k>=80 THEN 'evaluated' ELSE 'insufficient_valid_resamples' END AS status, CASE WHEN e>0 THEN 'a' WHEN e<0 THEN 'b' WHEN e=0 THEN 'tie' END AS winner,
 CASE WHEN k<80 THEN NULL WHEN lo>=0.02 THEN 'confident_improvement' WHEN hi<=-0.02 THEN 'confident_regression' ELSE 'inconclusive' END AS decision, CASE WHEN k<80 THEN NULL WHEN lo>=-0.1 THEN 'noninferior' ELSE 'not_established' END AS noninferiority,
 round(p,6) AS p_value, false AS prespecified, round(CASE WHEN p IS NOT NULL THEN adj END,6) AS adjusted_p, CASE WHEN p IS NOT NULL THEN adj<=0.05 END AS reject, CASE WHEN q.sc='' THEN 'not_in_family' WHEN p IS NULL THEN 'not_testable' ELSE 'evaluated' END AS test_status
 FROM q LEFT JOIN a USING (sc, sv, metric)""")
def paired_areas(spark, sf_dir):
    """Two scores of labelled documents: areas and hits under draws and swaps of whole sources, for all and by language, tests of the languages adjusted together."""
    v = eval_doc(spark, sf_dir).select("sample_id", "y", F.col("score").alias("p_a"), (F.col("sample_id") * 37 % 101 / 100.0).alias("p_b"), "lang", "source")
    design = SamplingDesign("source", "cluster_bootstrap", ("source",), min_independent_units=2, max_resample_rows=ANY, exchangeability="model_vectors_within_clusters", multiplicity=MultiplicityPolicy())
    config = PairedConfig(resamples=N, permutations=N, seed=SEED, practical_threshold=0.02, noninferiority_margin=0.1, include_slice_uncertainty=True)
    return rounded(resampled.paired_intervals(v, "sample_id", "y", "p_a", "p_b", "binary", metrics=["accuracy", "auroc"], slices=("lang",), design=design, config=config, mode="md5"))


def _models_sql(names: str, weights: dict[str, tuple]) -> str:
    parts = ", ".join(f"(1+(o_orderkey*{m})%{d})::double AS {n}{i}" for n, pairs in weights.items() for i, (m, d) in enumerate(pairs))
    probs = ", ".join(f"[{n}0/({n}0+{n}1+{n}2), {n}1/({n}0+{n}1+{n}2), {n}2/({n}0+{n}1+{n}2)] AS p_{n}" for n in weights)
    return f"e AS (SELECT o_orderkey, o_custkey AS unit, o_orderpriority AS priority, y, {probs} FROM (SELECT *, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END)::int AS y, {parts} FROM orders))"


_WEIGHTS = {"a": ((7, 11), (5, 13), (3, 17)), "b": ((11, 7), (3, 19), (13, 5))}
_VECTOR = ", ".join(["sum(1)::double AS n", *(f"sum((y={k})::int)::double AS t{k}" for k in range(3)), *(f"sum((g_{m}={k})::int)::double AS g{k}_{m}, sum((g_{m}={k} AND y={k})::int)::double AS x{k}_{m}" for m in "ab" for k in range(3)),
                     *(f"sum((g_{m}=y)::int)::double AS h_{m}, sum(-ln(greatest(least(p_{m}[y+1],1-2.220446049250313e-16),2.220446049250313e-16))) AS l_{m}" for m in "ab")])
_SUMMED = ["n", *(f"t{k}" for k in range(3)), *(f"{c}{k}_{m}" for m in "ab" for k in range(3) for c in "gx"), *(f"{c}_{m}" for m in "ab" for c in "hl")]


def _class_metrics(source: str, flip: bool) -> str:
    """(sc, sv, b, metric, a, b2) from unit vectors joined as ``source``; with ``flip`` models change places where a unit is flipped."""
    pick = lambda c: f"CASE WHEN flip THEN {c[:-1]}{'b' if c[-1] == 'a' else 'a'} ELSE {c} END" if flip and c.endswith(("_a", "_b")) else c
    sums = ", ".join(f"sum({pick(c)}) AS {c}" for c in _SUMMED)
    f1 = lambda m: "(" + "+".join(f"coalesce(2*x{k}_{m}/nullif(t{k}+g{k}_{m},0),0)" for k in range(3)) + ")/3"
    metrics = {"accuracy": lambda m: f"h_{m}/n", "macro_f1": f1, "log_loss": lambda m: f"l_{m}/n"}
    return " UNION ALL ".join(f"SELECT sc, sv, b, '{k}' AS metric, {v('a')} AS a, {v('b')} AS b2 FROM (SELECT sc, sv, b, {sums} FROM {source} GROUP BY ALL)" for k, v in metrics.items())


_GAIN = "CASE metric WHEN 'log_loss' THEN b2-a ELSE a-b2 END"


@query(f"""WITH {_models_sql('ab', _WEIGHTS)}, c AS (SELECT *, list_position(p_a, list_max(p_a))-1 AS g_a, list_position(p_b, list_max(p_b))-1 AS g_b FROM e),
 r AS (SELECT '' AS sc, '' AS sv, '' AS st, unit, {_VECTOR} FROM c GROUP BY unit UNION ALL SELECT 'priority', priority, '', unit, {_VECTOR} FROM c GROUP BY priority, unit), {_draws('r')},
 z AS (SELECT d.b, r.* FROM d JOIN r ON d.sc=r.sc AND d.sv=r.sv AND d.unit=r.unit), y2 AS (SELECT f.b, f.flip, r.* FROM f JOIN r ON f.sc=r.sc AND f.sv=r.sv AND f.unit=r.unit), v AS ({_class_metrics('z', False)}), v2 AS ({_class_metrics('y2', True)}), g AS (SELECT *, {_GAIN} AS g FROM v), sw AS (SELECT *, {_GAIN} AS g FROM v2),
 i AS (SELECT sc, sv, metric, max(CASE WHEN b={N} THEN a END) AS ma, max(CASE WHEN b={N} THEN b2 END) AS mb, max(CASE WHEN b={N} THEN g END) AS e, count(CASE WHEN b<{N} THEN g END) AS k, quantile_cont(CASE WHEN b<{N} THEN g END,0.025) AS lo, quantile_cont(CASE WHEN b<{N} THEN g END,0.975) AS hi FROM g GROUP BY ALL),
 s AS (SELECT sc, sv, sum(n)::bigint AS n, count(*) AS n_units FROM r GROUP BY 1,2), {_PAIRED.format(n=N, need=80)}, k AS (SELECT *, sv IN ('1-URGENT','5-LOW') AS pre FROM q UNION ALL SELECT 'priority','9-NEVER', metric, NULL, NULL, NULL, 0, NULL, NULL, 0, NULL, 'fine', NULL, true FROM (SELECT DISTINCT metric FROM q)),
 h AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY coalesce(p,1)) AS pos, count(*) OVER (PARTITION BY metric) AS m FROM k WHERE pre), a AS (SELECT sc, sv, metric, least(min(coalesce(p,1)*m/pos) OVER (PARTITION BY metric ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),1) AS adj FROM h)
 SELECT k.sc AS slice_column, k.sv AS slice_value, metric, n, n_units, round(ma,6) AS metric_a, round(mb,6) AS metric_b, round(e,6) AS improvement, CASE WHEN k>=80 THEN round(lo,6) END AS lower, CASE WHEN k>=80 THEN round(hi,6) END AS upper, k AS valid_resamples,
 CASE WHEN sv='9-NEVER' THEN 'missing_prespecified_slice' WHEN pl<>'fine' THEN pl WHEN e IS NULL THEN 'metric_undefined' WHEN k>=80 THEN 'evaluated' ELSE 'insufficient_valid_resamples' END AS status, CASE WHEN e>0 THEN 'a' WHEN e<0 THEN 'b' WHEN e=0 THEN 'tie' END AS winner,
 CASE WHEN k<80 THEN NULL WHEN lo>0 THEN 'confident_improvement' WHEN hi<0 THEN 'confident_regression' ELSE 'inconclusive' END AS decision, NULL::varchar AS noninferiority, round(p,6) AS p_value, pre AS prespecified,
 round(CASE WHEN p IS NOT NULL THEN adj END,6) AS adjusted_p, CASE WHEN p IS NOT NULL THEN adj<=0.05 END AS reject, CASE WHEN NOT pre THEN 'not_in_family' WHEN p IS NULL THEN 'not_testable' ELSE 'evaluated' END AS test_status FROM k LEFT JOIN a USING (sc, sv, metric)""")
def paired_classes(spark, sf_dir):
    """Two models of order statuses: class metrics under draws and swaps of customers, by priority, with declared slices of which one is absent."""
    k = F.col("o_orderkey")
    weights = {m: [(1 + (k * x) % d).cast("double") for x, d in pairs] for m, pairs in _WEIGHTS.items()}
    probs = [F.array(*(x / (w[0] + w[1] + w[2]) for x in w)).alias(f"p_{m}") for m, w in weights.items()]
    y = (F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")) - 1).cast("int")
    v = table(spark, sf_dir, "orders").select(k.alias("sample_id"), y.alias("y"), *probs, F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("priority"))
    policy = MultiplicityPolicy("benjamini_hochberg", "critical_slices", 0.05, "independent_or_prds")
    design = SamplingDesign("customer", "cluster_bootstrap", ("unit",), min_independent_units=2, max_resample_rows=ANY, exchangeability="model_vectors_within_clusters", critical_slices=(("priority", "1-URGENT"), ("priority", "5-LOW"), ("priority", "9-NEVER")), multiplicity=policy)
    config = PairedConfig(resamples=N, permutations=N, seed=SEED, include_slice_uncertainty=True)
    return rounded(resampled.paired_intervals(v, "sample_id", "y", "p_a", "p_b", "multiclass", 3, ["accuracy", "macro_f1", "log_loss"], ("priority",), design, config, "md5"))


_LIMITS = {"none drawn, too many": 0.5, "none drawn, fine": 1e6, "counted": 1.02}


@query(f"""WITH {REG}, u AS (SELECT unit, count(*) AS n FROM eval_reg GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY unit::varchar)-1 AS slot, count(*) OVER () AS size FROM u), w AS (SELECT b, {_H.format(k=f"'{SEED}|//|'||b||'|'||slot")}%size AS at FROM x, range({N}) t(b)),
 m AS (SELECT max(n) AS most FROM (SELECT b, sum(n) AS n FROM w JOIN x ON w.at=x.slot GROUP BY b)), a AS (SELECT sum(n)::bigint AS n, count(*) AS n_units, count(*)*max(n) AS high, count(*)*min(n) AS low FROM u), l AS (SELECT * FROM (VALUES ('none drawn, too many',0.0::double),('none drawn, fine',1e6::double),('counted',1.02::double)) t("case", factor))
 SELECT "case", n, n_units, CASE WHEN low>lim THEN 'not_supported_resource_limit' WHEN high<=lim THEN 'evaluated' WHEN most>lim THEN 'not_supported_resource_limit' ELSE 'evaluated' END AS status FROM (SELECT *, CASE WHEN factor=0 THEN greatest(low-1,2) ELSE floor(n*factor) END AS lim FROM l, a, m)""")
def resample_limits(spark, sf_dir):
    """Whether a replicate exceeds the limit of rows: told by bounds without any draw where these suffice, else by drawing counts."""
    v = eval_reg(spark, sf_dir)
    sizes = v.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.min("n"), F.sum("n")).first()
    units = resampled.unit_vectors(resampled.keyed_rows(v, "sample_id", "y", {"a": "p_a"}, [], SamplingDesign("customer", "cluster_bootstrap", ("unit",)), "regression"), "__unit", "__stratum", "y", {"a": "p_a"}, "regression", 2)[0]
    units, out = units.withColumnRenamed("__unit", "unit").withColumnRenamed("__stratum", "stratum"), None
    for name, limit in (("none drawn, too many", max(sizes[0] * sizes[1] - 1, 2)), ("none drawn, fine", int(sizes[2] * 1e6)), ("counted", int(sizes[2] * 1.02))):
        design = SamplingDesign("customer", "cluster_bootstrap", ("unit",), min_independent_units=2, max_resample_rows=int(limit))
        one = resampled.decided(units, design, 20, N, SEED, "md5").select(F.lit(name).alias("case"), "n", "n_units", "status")
        out = one if out is None else out.union(one)
    return rounded(out)


@query()
def intervals_by_counts(spark, sf_dir):
    """Regression metrics of single rows by multinomial counts, for all orders and by status; these draws have no SQL."""
    return rounded(resampled.metric_intervals(eval_reg(spark, sf_dir), "sample_id", "y", "p_a", "regression", slices=("status",), config=BootstrapConfig(resamples=200, seed=SEED, include_slices=True)))


@query("""WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey%2=0 THEN 'train' ELSE 'test' END AS role, list_sort(list_distinct(string_split(p_type,' ') || [p_brand, substr(p_name,1,4)])) AS s FROM part),
 p AS (SELECT a.k AS x, b.k AS y FROM f a, f b WHERE a.role='train' AND b.role='test' AND len(list_intersect(a.s,b.s)) >= 0.6*(len(a.s)+len(b.s)-len(list_intersect(a.s,b.s)))-1e-9), t AS (SELECT x AS k FROM p UNION SELECT y FROM p)
 SELECT 'within' AS budget, 'near_duplicates' AS "check", count(*) AS affected_records, CASE WHEN count(*)>0 THEN 'fail' ELSE 'pass' END AS status FROM t UNION ALL SELECT 'beyond', 'near_duplicates', NULL, 'pair_budget_exceeded'""")
def audit_pair_budget(spark, sf_dir):
    """Parts with the same words, once within a budget of candidate pairs and once beyond it."""
    from quillmark.operators import audit

    words = F.array_union(F.split("p_type", " "), F.array("p_brand", F.substring("p_name", 1, 4)))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "train").otherwise("test").alias("role"), words.alias("set"))
    one = lambda name, budget: audit.tanimoto_finding(rows, "p_partkey", "set", "role", [("train", "test")], 0.6, budget).select(F.lit(name).alias("budget"), "check", "affected_records", "status")
    return one("within", 10**15).union(one("beyond", 0))


@query("""WITH c AS (SELECT o_custkey AS label, count(*) AS n, count(*) FILTER (o_orderstatus='F') AS f FROM orders GROUP BY 1), a AS (SELECT count(*) FILTER (o_orderstatus='F')/count(*) AS share FROM orders), t AS (SELECT label, exp(-2*n*(f/n-share)*(f/n-share)) AS p FROM c, a WHERE n>=3),
 s AS (SELECT c_custkey AS label, p FROM customer LEFT JOIN t ON c_custkey=label WHERE c_mktsegment='BUILDING'), r AS (SELECT *, row_number() OVER (ORDER BY coalesce(p,1)) AS k, count(*) OVER () AS m FROM s), w AS (SELECT *, coalesce(p,1)*m*(SELECT sum(1.0::double/i) FROM range(1,m+1) z(i))/k AS q FROM r),
 z AS (SELECT *, least(min(q) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),1) AS y FROM w) SELECT label, round(p,6) AS p, round(CASE WHEN p IS NOT NULL THEN y END,6) AS adjusted_p, CASE WHEN p IS NOT NULL THEN y<=0.05 END AS reject FROM z""")
def approved_tests(spark, sf_dir):
    """Bounds of customers' shares of one status as p values; only the customers of one segment may be shown, and their family is adjusted anew."""
    from quillmark.operators.privacy import approved_family

    orders = table(spark, sf_dir, "orders")
    share = orders.agg((F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("share"))
    gap = F.col("f") / F.col("n") - F.col("share")
    tests = orders.groupBy(F.col("o_custkey").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f")).where("n >= 3").crossJoin(share).select("label", F.exp(-2 * F.col("n") * gap * gap).alias("p"))
    shown = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("label"))
    return rounded(approved_family(tests, shown, ["label"], "p"))


_LINE = "c_custkey||','||c_nationkey||',\"'||replace(c_name,'\"','\"\"')||'; '||c_mktsegment||'\"'"


@query(f"""SELECT c_mktsegment AS segment, count(*) AS n, sum(c_custkey)::bigint AS keys, count(DISTINCT c_nationkey) AS nations, sha256(string_agg({_LINE}||chr(10), '' ORDER BY c_custkey)) AS sha256 FROM customer GROUP BY 1""")
def scan_digests(spark, sf_dir):
    """Customers written as a CSV file for each segment, then rows and digests of these files by one read of each."""
    from quillmark.sources.scratch import shared_folder
    from quillmark.sources.tables import scanned_files, verified_rows

    c = table(spark, sf_dir, "customer")
    text = F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.concat(F.lit('"'), F.replace("c_name", F.lit('"'), F.lit('""')), F.lit("; "), F.col("c_mktsegment"), F.lit('"')))
    folder = f"{shared_folder(spark)}/quillmark/segments-{uuid.uuid4().hex}"
    c.select("c_custkey", "c_mktsegment", text.alias("value")).repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey").select("value", "c_mktsegment").write.partitionBy("c_mktsegment").text(folder)
    scan = scanned_files(spark, folder, ["key", "nation", "name"], header=False)
    pins = {"/".join(r.path.rsplit("/", 2)[1:]): r.d for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.sha2("content", 256).alias("d")).collect()}  # a file for each segment, by its folder, as a task gives the files of all its segments one name
    rows = verified_rows(scan, pins)
    segment = F.regexp_extract("name", "; (.*)$", 1).alias("segment")
    return rounded(rows.groupBy(segment, "sha256").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("key").cast("long")).alias("keys"), F.countDistinct("nation").alias("nations")))
