"""Catalogue: embedding and prediction windows, interpretation."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions.columns import let
from proofline.operators import compare, outputs, profile, vectors
from proofline.session import table

LABELS = tuple(f"c{i}" for i in range(64))


def _windows(spark, sf_dir):
    """Even vectors are the reference; the current ones are moved and stretched a little."""
    current = F.col("vec_id") % 2 == 1
    moved = F.when(current, F.transform("embedding", lambda x: x.cast("double") * 1.5 + 0.1)).otherwise(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", moved.alias("v"), F.when(current, "CURRENT").otherwise("REFERENCE").alias("role"))


def vector_validate(spark, sf_dir):
    odd = F.when(F.col("vec_id") % 50 == 1, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 50 == 2, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    df = table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 50 == 3, 3).otherwise(F.col("vec_id")).alias("vec_id"), odd.alias("v"))
    return vectors.validate(df, "vec_id", "v", 64).groupBy(F.coalesce("problem", F.lit("-")).alias("problem")).count().withColumnRenamed("count", "n")


def vector_profile(spark, sf_dir):
    found = vectors.vector_profile(_windows(spark, sf_dir), ("role",), "v")
    r = lambda c: F.round(c, 6)
    return found.select("role", F.col("norm.count").alias("n"), r(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x)).alias("centroid_sq"), r(F.aggregate("variance", F.lit(0.0), lambda s, x: s + x)).alias("total_variance"), r(F.col("norm.mean")).alias("norm_mean"), r(F.col("norm.q95")).alias("norm_q95"), r(F.col("radial.median")).alias("radial_median"), r("rms_radius").alias("rms_radius"))


def vector_covariance(spark, sf_dir):
    return vectors.covariance(table(spark, sf_dir, "embeddings"), "embedding").where("i <= j").select("i", "j", F.round("value", 8).alias("value"))


def vector_shift(spark, sf_dir):
    found = vectors.moved(vectors.vector_profile(_windows(spark, sf_dir), ("label", "role"), "v"), ("label",))
    return found.select("label", "n_ref", "n_cur", *(F.round(c, 6).alias(c) for c in ("centroid_cosine", "centroid_shift", "radial_smd", "radial_quantile", "radial_median", "variance_l2", "variance_cosine", "variance_total")), "centroid_state", "dispersion_state", "variance_state")


def vector_collapse(spark, sf_dir):
    """Windows of constant vectors, of a centroid without length, and of both, beside ordinary ones."""
    k, current = F.col("label") % 4, F.col("vec_id") % 2 == 1
    ones, steps = F.transform("embedding", lambda x: F.lit(1.0)), F.transform("embedding", lambda x, i: i.cast("double"))
    zeros = F.transform("embedding", lambda x: F.lit(0.0))
    v = F.when(k == 0, F.when(current, steps).otherwise(ones)).when((k == 1) & ~current, zeros).when(k == 2, zeros).otherwise(F.col("embedding").cast("array<double>"))
    windows = table(spark, sf_dir, "embeddings").select("label", v.alias("v"), F.when(current, "CURRENT").otherwise("REFERENCE").alias("role"))
    found = vectors.moved(vectors.vector_profile(windows, ("label", "role"), "v"), ("label",))
    return found.select("label", "n_ref", "n_cur", "centroid_state", "dispersion_state", "variance_state", *(F.round(c, 6).alias(c) for c in ("centroid_cosine", "centroid_shift", "variance_total")))


def vector_mmd(spark, sf_dir):
    return vectors.mmd(_windows(spark, sf_dir), "vec_id", "v").select(F.round("mmd", 7).alias("mmd"), "state")


def vector_support(spark, sf_dir):
    return vectors.nearest_support(_windows(spark, sf_dir), "vec_id", "v").select(*(F.round(c, 6).alias(c) for c in ("ratio", "mean", "q95")), "state")


def vector_sample(spark, sf_dir):
    return vectors.spaced(_windows(spark, sf_dir).select("role", "vec_id"), ("role",), "vec_id", 30)


def _predictions(spark, sf_dir):
    """Softmax over the whole vector, tenfold; labels by argmax, some spoilt by rule."""
    base = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.exp(x.cast("double") * 10)).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda s, y: s + y)
    p = base.withColumn("probabilities", let(total, lambda t: F.transform("e", lambda x: x / t)))
    top = F.array_position("probabilities", F.array_max("probabilities")) - 1
    k = F.col("vec_id") % 40
    return p.select(
        F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("sample_id"),
        F.when(k == 1, "zz").when(k == 2, F.concat(F.lit("c"), ((top + 1) % 64).cast("string"))).otherwise(F.concat(F.lit("c"), top.cast("string"))).alias("predicted_label"),
        F.when(k == 3, 1.5).when(k == 4, F.array_max("probabilities") / 2).otherwise(F.array_max("probabilities")).alias("confidence"),
        F.when(k == 5, F.slice("probabilities", 1, 63)).when(k == 6, F.transform("probabilities", lambda x: x / 2)).otherwise(F.col("probabilities")).alias("probabilities"),
        ((F.col("vec_id") * 7 + F.col("label")) % 11 < F.when(F.col("vec_id") % 2 == 0, 1).otherwise(3)).alias("abstained"),
        F.lit(None).cast("boolean").alias("unknown_or_ood"),
        F.when(F.col("vec_id") % 2 == 0, "REFERENCE").otherwise("CURRENT").alias("role"),
    )


def _coded(spark, sf_dir):
    return _predictions(spark, sf_dir).withColumn("code", outputs.prediction_code(LABELS, abstention=True))


def prediction_validate(spark, sf_dir):
    return _coded(spark, sf_dir).select("sample_id", F.coalesce("code", F.lit("-")).alias("code"))


def _valid(spark, sf_dir):
    return outputs.measured(_coded(spark, sf_dir).where("code IS NULL"))


def prediction_labels(spark, sf_dir):
    return outputs.label_counts(_valid(spark, sf_dir), ("role",), LABELS)


def _profile(spark, sf_dir):
    return profile.numeric_profile(profile.long_form(_valid(spark, sf_dir), ("top1", "entropy", "margin"), ("role",)), ("feature", "role"))


def prediction_profile(spark, sf_dir):
    return _profile(spark, sf_dir).select("role", "feature", "count", *(F.round(c, 6).alias(c) for c in profile.SUMMARY[1:]))


def prediction_shift(spark, sf_dir):
    values = profile.long_form(_valid(spark, sf_dir), ("top1", "entropy", "margin"), ("role",))
    numeric = compare.continuous(_profile(spark, sf_dir), ("feature",), compare.divergences(profile.histogram(values, ("feature", "role"), 50), ("feature",), "bin", 50)).select("feature", "state")
    labels = compare.categorical(outputs.label_counts(_valid(spark, sf_dir), ("role",), LABELS).withColumn("feature", F.lit("labels")), ("feature",)).select("feature", "state")
    rate = outputs.rate_shift(outputs.rates(_valid(spark, sf_dir), ("role",)).withColumn("feature", F.lit("abstention")), ("feature",), "abstention_rate").select("feature", "state")
    return numeric.unionByName(labels).unionByName(rate)


def _reports(spark, sf_dir):
    """A report of up to three layers for each customer, by key."""
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(k.alias("key"), F.explode(F.array(*(F.struct(F.lit(x).alias("layer"), F.lit(i).alias("i")) for i, x in enumerate(outputs.LAYERS)))).alias("l")).select("key", "l.*")
    turn = (F.col("key") * 7 + F.col("i") * 3) % 11
    status = F.when(turn < 7, "COMPLETE").when(turn < 9, "PARTIAL").otherwise("UNAVAILABLE")
    shifted = F.when(((F.col("key") + F.col("i") * F.col("key")) % 3 == 0) & (turn < 9), "a,b").otherwise("")
    return base.where((F.col("key") + F.col("i")) % 13 != 0).select("key", "layer", status.alias("status"), shifted.alias("shifted"))


def interpretation(spark, sf_dir):
    return outputs.interpret(_reports(spark, sf_dir), ("key",)).select("key", "pattern", "changed_layers", "incomplete_layers", "missing_layers", "interpretation_id")


def shift_findings(spark, sf_dir):
    return outputs.shift_findings(outputs.interpret(_reports(spark, sf_dir), ("key",))).select("key", "category", "severity", "confidence")


_W = "w AS (SELECT vec_id, label, CASE WHEN vec_id % 2 = 1 THEN list_transform(embedding, lambda x: x::DOUBLE * 1.5 + 0.1) ELSE embedding::DOUBLE[] END AS v, CASE WHEN vec_id % 2 = 1 THEN 'CURRENT' ELSE 'REFERENCE' END AS role FROM embeddings)"


_COLLAPSED = """w AS (SELECT vec_id, label, CASE WHEN label % 4 = 0 AND vec_id % 2 = 1 THEN list_transform(range(0, 64), lambda i: i::DOUBLE) WHEN label % 4 = 0 THEN list_transform(range(0, 64), lambda i: 1::DOUBLE)
  WHEN label % 4 = 2 OR (label % 4 = 1 AND vec_id % 2 = 0) THEN list_transform(range(0, 64), lambda i: 0::DOUBLE) ELSE embedding::DOUBLE[] END AS v, CASE WHEN vec_id % 2 = 1 THEN 'CURRENT' ELSE 'REFERENCE' END AS role FROM embeddings)"""


def _moments(keys: str, windows: str = _W) -> str:
    return f"""{windows},
d AS (SELECT {keys}, i, avg(v[i]) AS m, var_pop(v[i]) AS s FROM w, range(1, 65) t(i) GROUP BY ALL),
c AS (SELECT {keys}, list(m ORDER BY i) AS c, list(s ORDER BY i) AS s FROM d GROUP BY {keys}),
x AS (SELECT {", ".join("w." + k.strip() for k in keys.split(","))}, sqrt(list_dot_product(v, v)) AS nrm, list_distance(v, c) AS rad FROM w JOIN c USING ({keys})),
p AS (SELECT {keys}, count(*) AS n, avg(nrm) AS nm, quantile_cont(nrm, 0.95) AS n95, avg(rad) AS rm, stddev_pop(rad) AS rs, sqrt(avg(rad * rad)) AS rms, quantile_cont(rad, 0.05) AS q1, quantile_cont(rad, 0.25) AS q2, quantile_cont(rad, 0.5) AS q3, quantile_cont(rad, 0.75) AS q4, quantile_cont(rad, 0.95) AS q5 FROM x GROUP BY {keys})"""


_PRED = """
b AS (SELECT vec_id, label, list_transform(embedding, lambda x: exp(x::DOUBLE * 10)) AS e FROM embeddings),
p0 AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM b),
t AS (SELECT vec_id, label, p, list_position(p, list_max(p)) - 1 AS top, list_max(p) AS mx, vec_id % 40 AS k, CASE WHEN vec_id % 2 = 0 THEN 'REFERENCE' ELSE 'CURRENT' END AS role,
  (vec_id * 7 + label) % 11 < CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 3 END AS ab FROM p0),
c AS (SELECT *, CASE k WHEN 1 THEN 'INVALID_LABEL' WHEN 2 THEN 'LABEL_ARGMAX_MISMATCH' WHEN 3 THEN 'INVALID_CONFIDENCE' WHEN 4 THEN 'CONFIDENCE_PROBABILITY_MISMATCH' WHEN 5 THEN 'INVALID_PROBABILITY_VECTOR' WHEN 6 THEN 'PROBABILITY_SUM_MISMATCH' END AS code FROM t),
g AS (SELECT role, 'c' || top AS lab, ab, mx AS top1, -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * log2(x) ELSE 0 END)) / log2(64) AS entropy, mx - list_sort(p, 'DESC')[2] AS margin FROM c WHERE code IS NULL),
u AS (SELECT role, unnest(['top1', 'entropy', 'margin']) AS feature, unnest([top1, entropy, margin]) AS value FROM g),
q AS (SELECT role, feature, count(*) AS count, min(value) AS minimum, max(value) AS maximum, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS q95 FROM u GROUP BY ALL)"""
_SHIFT = """
n AS (SELECT x.feature, x.count AS n_ref, y.count AS n_cur, abs(y.mean - x.mean) / sqrt((x.std ^ 2 + y.std ^ 2) / 2) AS smd,
  greatest(abs(y.q05 - x.q05), abs(y.q25 - x.q25), abs(y.median - x.median), abs(y.q75 - x.q75), abs(y.q95 - x.q95)) / greatest(x.q95 - x.q05, y.q95 - y.q05) AS quantile,
  2 * abs(y.median - x.median) / (abs(x.median) + abs(y.median)) AS median FROM q x JOIN q y ON x.feature = y.feature AND x.role = 'REFERENCE' AND y.role = 'CURRENT'),
h AS (SELECT feature, least(floor(value * 50), 49)::INTEGER AS bin, count(*) FILTER (role = 'REFERENCE') AS a, count(*) FILTER (role = 'CURRENT') AS b FROM u WHERE value BETWEEN 0 AND 1 GROUP BY ALL),
k AS (SELECT feature, i AS bin, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT DISTINCT feature FROM h) CROSS JOIN range(0, 50) r(i) LEFT JOIN h USING (feature) WHERE h.bin = i
  UNION ALL SELECT feature, i, 0, 0 FROM (SELECT DISTINCT feature FROM h) d CROSS JOIN range(0, 50) r(i) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.feature = d.feature AND h.bin = i)),
l AS (SELECT 'labels' AS feature, lab AS bin, count(*) FILTER (role = 'REFERENCE') AS a, count(*) FILTER (role = 'CURRENT') AS b FROM g GROUP BY lab),
s AS (SELECT feature, bin, a / sum(a) OVER (PARTITION BY feature) AS p, b / sum(b) OVER (PARTITION BY feature) AS q FROM k),
e AS (SELECT feature, p, q, abs(sum(p - q) OVER (PARTITION BY feature ORDER BY bin)) AS gap FROM s),
v AS (SELECT feature, p, q, gap FROM e UNION ALL SELECT feature, a / sum(a) OVER (), b / sum(b) OVER (), NULL FROM l),
d AS (SELECT feature, sum(((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2) AS js, sum(abs(p - q)) / 2 AS tv, sum(gap) / 50 AS wasserstein FROM v GROUP BY feature),
z AS (SELECT feature, n_ref, n_cur, (smd >= 0.8)::INT + (quantile >= 0.5)::INT + (median >= 0.25)::INT + (js >= 0.1)::INT + (tv >= 0.25)::INT + (wasserstein >= 0.1)::INT >= 2 AS moved FROM n JOIN d USING (feature)
  UNION ALL SELECT 'labels', (SELECT sum(a) FROM l), (SELECT sum(b) FROM l), js >= 0.1 AND tv >= 0.25 FROM d WHERE feature = 'labels'
  UNION ALL SELECT 'abstention', 20, 20, abs(avg(ab::INT) FILTER (role = 'CURRENT') - avg(ab::INT) FILTER (role = 'REFERENCE')) >= 0.1 FROM g)
SELECT feature, CASE WHEN least(n_ref, n_cur) < 20 THEN 'INSUFFICIENT' WHEN moved THEN 'SHIFTED' ELSE 'STABLE' END AS state FROM z"""
_LAYER = """
l AS (SELECT c_custkey AS key, i, ['IMAGE', 'REPRESENTATION', 'OUTPUT'][i + 1] AS layer FROM customer, range(0, 3) t(i) WHERE (c_custkey + i) % 13 <> 0),
r AS (SELECT *, CASE WHEN (key * 7 + i * 3) % 11 < 7 THEN 'COMPLETE' WHEN (key * 7 + i * 3) % 11 < 9 THEN 'PARTIAL' ELSE 'UNAVAILABLE' END AS status, (key + i * key) % 3 = 0 AND (key * 7 + i * 3) % 11 < 9 AS hit FROM l),
a AS (SELECT key, coalesce(string_agg(layer, ',' ORDER BY i) FILTER (hit), '') AS changed_layers, coalesce(string_agg(layer, ',' ORDER BY i) FILTER (status = 'PARTIAL'), '') AS incomplete_layers, count(*) FILTER (hit) AS changed,
  array_to_string(list_filter(['IMAGE', 'REPRESENTATION', 'OUTPUT'], lambda x: NOT list_contains(coalesce(list(layer) FILTER (status <> 'UNAVAILABLE'), []), x)), ',') AS missing_layers, count(*) FILTER (status = 'COMPLETE') = 3 AS complete, count(*) FILTER (status <> 'UNAVAILABLE') > 0 AS usable FROM r GROUP BY key),
z AS (SELECT *, CASE WHEN NOT usable THEN 'DISTRIBUTION_SHIFT_EVIDENCE_UNAVAILABLE' WHEN changed = 3 THEN 'BROAD_MULTILAYER_SHIFT' WHEN changed = 0 AND complete THEN 'NO_SHIFT_OBSERVED' WHEN changed = 0 THEN 'DISTRIBUTION_SHIFT_EVIDENCE_INCOMPLETE' WHEN NOT complete THEN 'DISTRIBUTION_SHIFT_WITH_INCOMPLETE_COVERAGE' WHEN changed = 2 THEN replace(changed_layers, ',', '_AND_') || '_SHIFT' ELSE changed_layers || '_SHIFT_ONLY' END AS pattern FROM a)"""
_SMD = "abs(y.rm - x.rm) / sqrt((x.rs ^ 2 + y.rs ^ 2) / 2)"
_QS = "greatest(abs(y.q1 - x.q1), abs(y.q2 - x.q2), abs(y.q3 - x.q3), abs(y.q4 - x.q4), abs(y.q5 - x.q5)) / greatest(x.q5 - x.q1, y.q5 - y.q1)"

QUERIES = {
    "vector_validate": (vector_validate, "WITH k AS (SELECT CASE WHEN vec_id % 50 = 3 THEN 3 ELSE vec_id END AS id, vec_id % 50 AS r FROM embeddings), d AS (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM k) SELECT CASE WHEN r = 1 THEN 'WRONG_DIMENSION' WHEN r = 2 THEN 'NOT_FINITE' WHEN c > 1 THEN 'DUPLICATE_ID' ELSE '-' END AS problem, count(*) AS n FROM d GROUP BY 1"),
    "vector_profile": (vector_profile, f"WITH {_moments('role')} SELECT role, n, round(list_dot_product(c, c), 6) AS centroid_sq, round(list_sum(s), 6) AS total_variance, round(nm, 6) AS norm_mean, round(n95, 6) AS norm_q95, round(q3, 6) AS radial_median, round(rms, 6) AS rms_radius FROM p JOIN c USING (role)"),
    "vector_covariance": (vector_covariance, "SELECT (i - 1)::INTEGER AS i, (j - 1)::INTEGER AS j, round(covar_pop(embedding[i]::DOUBLE, embedding[j]::DOUBLE), 8) AS value FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j GROUP BY ALL"),
    "vector_shift": (
        vector_shift,
        f"""WITH {_moments("label, role")}, m AS (SELECT x.label, x.n AS n_ref, y.n AS n_cur, 1 - list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c))) AS centroid_cosine, list_distance(a.c, b.c) / sqrt((x.rms ^ 2 + y.rms ^ 2) / 2) AS centroid_shift, {_SMD} AS radial_smd, {_QS} AS radial_quantile, 2 * abs(y.q3 - x.q3) / (abs(x.q3) + abs(y.q3)) AS radial_median,
        list_distance(a.s, b.s) / greatest(sqrt(list_dot_product(a.s, a.s)), sqrt(list_dot_product(b.s, b.s))) AS variance_l2, 1 - list_dot_product(a.s, b.s) / (sqrt(list_dot_product(a.s, a.s)) * sqrt(list_dot_product(b.s, b.s))) AS variance_cosine, abs(list_sum(b.s) - list_sum(a.s)) / greatest(list_sum(a.s), list_sum(b.s)) AS variance_total
        FROM p x JOIN p y ON x.label = y.label AND x.role = 'REFERENCE' AND y.role = 'CURRENT' JOIN c a ON a.label = x.label AND a.role = 'REFERENCE' JOIN c b ON b.label = x.label AND b.role = 'CURRENT')
        SELECT label, n_ref, n_cur, """
        + ", ".join(f"round({c}, 6) AS {c}" for c in ("centroid_cosine", "centroid_shift", "radial_smd", "radial_quantile", "radial_median", "variance_l2", "variance_cosine", "variance_total"))
        + """, CASE WHEN least(n_ref, n_cur) < 20 THEN 'INSUFFICIENT' WHEN centroid_cosine >= 0.1 AND centroid_shift >= 0.5 THEN 'SHIFTED' ELSE 'STABLE' END AS centroid_state,
        CASE WHEN least(n_ref, n_cur) < 20 THEN 'INSUFFICIENT' WHEN (radial_smd >= 0.5)::INT + (radial_quantile >= 0.5)::INT + (radial_median >= 0.5)::INT >= 2 THEN 'SHIFTED' ELSE 'STABLE' END AS dispersion_state,
        CASE WHEN least(n_ref, n_cur) < 20 THEN 'INSUFFICIENT' WHEN (variance_l2 >= 0.5)::INT + (variance_cosine >= 0.5)::INT + (variance_total >= 0.5)::INT >= 2 THEN 'SHIFTED' ELSE 'STABLE' END AS variance_state FROM m""",
    ),
    "vector_collapse": (
        vector_collapse,
        f"""WITH {_moments("label, role", _COLLAPSED)},
        m AS (SELECT x.label, x.n AS n_ref, y.n AS n_cur, sqrt(list_dot_product(a.c, a.c)) AS la, sqrt(list_dot_product(b.c, b.c)) AS lb, list_dot_product(a.c, b.c) AS ab, list_distance(a.c, b.c) AS gap, sqrt((x.rms ^ 2 + y.rms ^ 2) / 2) AS pooled,
          sqrt((x.rs ^ 2 + y.rs ^ 2) / 2) AS rscale, abs(y.rm - x.rm) AS rgap, greatest(x.q5 - x.q1, y.q5 - y.q1) AS qscale, greatest(abs(y.q1 - x.q1), abs(y.q2 - x.q2), abs(y.q3 - x.q3), abs(y.q4 - x.q4), abs(y.q5 - x.q5)) AS qgap, abs(y.q3 - x.q3) AS mgap, abs(x.q3) + abs(y.q3) AS msize,
          sqrt(list_dot_product(a.s, a.s)) AS va, sqrt(list_dot_product(b.s, b.s)) AS vb, list_dot_product(a.s, b.s) AS vab, list_distance(a.s, b.s) AS vgap, list_sum(a.s) AS ta, list_sum(b.s) AS tb
        FROM p x JOIN p y ON x.label = y.label AND x.role = 'REFERENCE' AND y.role = 'CURRENT' JOIN c a ON a.label = x.label AND a.role = 'REFERENCE' JOIN c b ON b.label = x.label AND b.role = 'CURRENT'),
        f AS (SELECT *, CASE WHEN la <= 1e-12 AND lb <= 1e-12 THEN 0 WHEN la > 1e-12 AND lb > 1e-12 THEN greatest(0, 1 - ab / (la * lb)) END AS centroid_cosine, CASE WHEN pooled > 1e-12 THEN gap / pooled WHEN gap <= 1e-12 THEN 0 END AS centroid_shift,
          CASE WHEN least(ta, tb) <= 1e-12 AND abs(tb - ta) > 1e-12 THEN NULL ELSE abs(tb - ta) / greatest(ta, tb, 1e-12) END AS variance_total,
          coalesce(rgap / CASE WHEN rscale > 1e-12 THEN rscale END >= 0.5, false)::INT + coalesce(qgap / CASE WHEN qscale > 1e-12 THEN qscale END >= 0.5, false)::INT + coalesce(2 * mgap / CASE WHEN msize > 1e-12 THEN msize END >= 0.5, false)::INT AS spread,
          coalesce(vgap / CASE WHEN greatest(va, vb) > 1e-12 THEN greatest(va, vb) END >= 0.5, false)::INT + coalesce(1 - vab / CASE WHEN va > 1e-12 AND vb > 1e-12 THEN va * vb END >= 0.5, false)::INT AS varied FROM m)
        SELECT label, n_ref, n_cur, round(centroid_cosine, 6) AS centroid_cosine, round(centroid_shift, 6) AS centroid_shift, round(variance_total, 6) AS variance_total,
          CASE WHEN least(n_ref, n_cur) < 20 THEN 'INSUFFICIENT' WHEN (la <= 1e-12) <> (lb <= 1e-12) OR (pooled <= 1e-12 AND gap > 1e-12) OR (centroid_cosine >= 0.1 AND centroid_shift >= 0.5) THEN 'SHIFTED' ELSE 'STABLE' END AS centroid_state,
          CASE WHEN least(n_ref, n_cur) < 20 THEN 'INSUFFICIENT' WHEN (rscale <= 1e-12 AND rgap > 1e-12) OR (qscale <= 1e-12 AND qgap > 1e-12) OR spread >= 2 THEN 'SHIFTED' ELSE 'STABLE' END AS dispersion_state,
          CASE WHEN least(n_ref, n_cur) < 20 THEN 'INSUFFICIENT' WHEN (va <= 1e-12) <> (vb <= 1e-12) OR (greatest(va, vb) <= 1e-12 AND vgap > 1e-12) OR varied + coalesce(variance_total >= 0.5, false)::INT >= 2 THEN 'SHIFTED' ELSE 'STABLE' END AS variance_state FROM f""",
    ),
    "vector_mmd": (
        vector_mmd,
        f"WITH {_W}, d AS (SELECT a.role AS ra, b.role AS rb, a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) ^ 2 AS d FROM w a, w b), h AS (SELECT quantile_cont(d, 0.5) AS m FROM d WHERE i < j), k AS (SELECT avg(exp(-d / (2 * m))) FILTER (ra = rb AND ra = 'REFERENCE') + avg(exp(-d / (2 * m))) FILTER (ra = rb AND ra = 'CURRENT') - 2 * avg(exp(-d / (2 * m))) FILTER (ra <> rb) AS mmd FROM d, h) SELECT round(mmd, 7) AS mmd, CASE WHEN mmd >= 0.05 THEN 'SHIFTED' ELSE 'STABLE' END AS state FROM k",
    ),
    "vector_support": (
        vector_support,
        f"WITH {_W}, d AS (SELECT a.role, a.vec_id, min(list_distance(a.v, b.v)) AS d FROM w a, w b WHERE b.role = 'REFERENCE' AND a.vec_id <> b.vec_id GROUP BY ALL), s AS (SELECT quantile_cont(d, 0.5) FILTER (role = 'CURRENT') / quantile_cont(d, 0.5) FILTER (role = 'REFERENCE') AS ratio, avg(d) FILTER (role = 'CURRENT') AS mean, quantile_cont(d, 0.95) FILTER (role = 'CURRENT') AS q95 FROM d) SELECT round(ratio, 6) AS ratio, round(mean, 6) AS mean, round(q95, 6) AS q95, CASE WHEN ratio >= 1.5 THEN 'SHIFTED' ELSE 'STABLE' END AS state FROM s",
    ),
    "vector_sample": (vector_sample, f"WITH {_W}, r AS (SELECT role, vec_id, row_number() OVER (PARTITION BY role ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY role) AS n FROM w) SELECT DISTINCT role, vec_id FROM r, range(0, 30) t(k) WHERE i = floor(k * (n - 1) / 29)"),
    "prediction_validate": (prediction_validate, f"WITH {_PRED} SELECT 's' || vec_id AS sample_id, coalesce(code, '-') AS code FROM c"),
    "prediction_labels": (prediction_labels, f"WITH {_PRED} SELECT role, i::INTEGER AS class_index, 'c' || i AS value, (SELECT count(*) FROM g WHERE g.role = r.role AND lab = 'c' || i) AS n FROM (SELECT DISTINCT role FROM g) r, range(0, 64) t(i)"),
    "prediction_profile": (prediction_profile, f"WITH {_PRED} SELECT role, feature, count, " + ", ".join(f"round({c}, 6) AS {c}" for c in profile.SUMMARY[1:]) + " FROM q"),
    "prediction_shift": (prediction_shift, f"WITH {_PRED}, {_SHIFT}"),
    "interpretation": (interpretation, f"WITH {_LAYER} SELECT key, pattern, changed_layers, incomplete_layers, missing_layers, sha256('{{\"changed\":\"' || changed_layers || '\",\"incomplete\":\"' || incomplete_layers || '\",\"missing\":\"' || missing_layers || '\",\"pattern\":\"' || pattern || '\"}}') AS interpretation_id FROM z"),
    "shift_findings": (shift_findings, f"WITH {_LAYER} SELECT key, pattern AS category, CASE WHEN pattern LIKE '%UNAVAILABLE' THEN 'MEDIUM' WHEN pattern LIKE '%EVIDENCE_INCOMPLETE' THEN 'LOW' WHEN changed = 1 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, CASE WHEN pattern LIKE '%EVIDENCE%' THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence FROM z WHERE pattern <> 'NO_SHIFT_OBSERVED'"),
}
