"""Catalogue: model graphs against structural rules, sizes of models, behaviour reports compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.operators import compare, models, vectors
from proofline.plans import representation
from proofline.session import table


def _graphs(spark, sf_dir):
    """Parts as pieces of graphs, a model for each size: a third are boundaries, a third nodes, a third initializers."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("model_id"), F.col("p_partkey").alias("k"), "p_name", "p_brand")
    k, m = F.col("k"), F.col("model_id") % 7
    direction = F.when(k % 2 == 0, "input").otherwise("output")
    size = F.when(k % 11 == 0, F.lit("batch")).when(k % 11 != 1, F.lit("64"))
    ends = p.where(k % 3 == 0).select("model_id", direction.alias("direction"), F.concat(F.lit("t"), k.cast("string")).alias("name"), F.array(F.lit("1"), size).alias("shape"))
    ends = ends.where(~((m == 1) & (F.col("direction") == "input")) & ~((m == 2) & (F.col("direction") == "output")))
    domain = F.when(k % 17 == 0, "custom.ops").when(k % 5 == 0, "ai.onnx").otherwise("")
    nodes = p.where((k % 3 == 1) & (m != 3)).select("model_id", k.alias("index"), F.when(k % 4 > 0, F.concat(F.lit("n"), k.cast("string"))).alias("name"), F.col("p_brand").alias("op_type"), domain.alias("domain"))
    places = ["", "../up.bin", "/etc/x", "c:/x", "a/%2e%2e/b", "data\\w.bin", "http://h/x", "w+1.bin"]
    place = F.get(F.array(*map(F.lit, places)), (k % 12).cast("int"))
    weights = p.where(k % 3 == 2).select("model_id", F.when(k % 13 > 0, F.col("p_name")).otherwise("").alias("name"), place.alias("location"), F.array(k % 1000, k % 7).alias("dims"))
    return p.select("model_id").distinct(), ends, nodes, weights


def structure_report(spark, sf_dir):
    found = models.structure_report(*_graphs(spark, sf_dir), approved=("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#23", "Brand#31", "Brand#32", "Brand#33"))
    return found.select("model_id", "code", "severity", F.array_join("evidence", ";").alias("evidence"))


def parameter_totals(spark, sf_dir):
    weights = _graphs(spark, sf_dir)[3]
    limited = models.structure_limitations(weights)
    return models.parameter_totals(weights).join(limited, "model_id", "left").select("model_id", "n_initializers", F.col("n_parameters").cast("long").alias("n_parameters"), F.coalesce("limitation", F.lit("-")).alias("limitation"))


def _behaviour(spark, sf_dir, left_out: int):
    """Parts as behaviour of triggers (brands) on models (sizes), and the issues that it has; one part in three is left out."""
    p = table(spark, sf_dir, "part").where(F.col("p_partkey") % 3 != left_out).select(F.col("p_size").alias("model_id"), F.col("p_brand").alias("trigger_id"), F.col("p_partkey").alias("k"))
    k = F.col("k")
    rates = p.groupBy("model_id", "trigger_id").agg(F.count("*").alias("pairs"), F.avg(k % 2).alias("flip_rate"), (F.avg(k % 5) / 10).alias("lift"), F.when(F.min("k") % 4 > 0, F.avg(k % 7) / 10).alias("control_relative"))
    code = F.get(F.array(*map(F.lit, ("TRIGGER_SENSITIVITY", "NONDETERMINISTIC_OUTPUT", "OUTPUT_NONFINITE", "TRIGGER_PREDICTION_FLIP"))), (k % 30).cast("int"))
    return rates, p.select("model_id", "trigger_id", code.alias("code")).where("code IS NOT NULL")


def behaviour_deltas(spark, sf_dir):
    found = models.behaviour_deltas(_behaviour(spark, sf_dir, 0)[0], _behaviour(spark, sf_dir, 1)[0])
    return found.select("model_id", "trigger_id", *(F.round(c, 9).alias(c) for c in ("flip_change", "lift_change", "control_change")))


def behaviour_report(spark, sf_dir):
    (before, old), (after, new) = _behaviour(spark, sf_dir, 0), _behaviour(spark, sf_dir, 1)
    m = F.col("model_id")
    reports = table(spark, sf_dir, "part").select(F.col("p_size").alias("model_id")).distinct().select("model_id", F.when(m % 9 == 0, "PARTIAL").otherwise("COMPLETE").alias("status_before"), F.when(m % 10 == 0, "UNAVAILABLE").otherwise("COMPLETE").alias("status_after"))
    found = models.behaviour_report(reports, models.behaviour_deltas(before, after), old, new)
    return found.select("model_id", "status", "state", F.array_join("codes", ",").alias("codes"), "n_new", "n_resolved", "n_persisting", F.array_join("limitations", ",").alias("limitations"))


def tensor_flags(spark, sf_dir):
    """Embeddings as channels of a tensor for each label: three labels have one huge channel, one is scaled as a whole."""
    from pyspark.sql import Window

    first = F.col("vec_id") == F.min("vec_id").over(Window.partitionBy("label"))
    e = table(spark, sf_dir, "embeddings")
    scale = F.when(first & (F.col("label") < 3), 1000.0).when(F.col("label") == 5, 50.0).otherwise(1.0)
    rows = e.withColumn("_s", scale).select(F.lit("m").alias("model_id"), F.concat(F.lit("t"), "label").alias("tensor"), F.col("vec_id").alias("channel"), F.transform("embedding", lambda x: x.cast("double") * F.col("_s")).alias("values"))
    norms = models.channel_norms(rows)
    stats = norms.groupBy("model_id", "tensor").agg((F.count("*") * 64).alias("elements"), F.sqrt(F.sum(F.col("l2") ** 2) / (F.count("*") * 64)).alias("rms")).withColumns({"rank": F.lit(2), "dtype": F.lit("FLOAT")})
    found = models.flagged_issues(models.energy(norms), models.peer_scale(stats))
    return found.select("tensor", "code", "severity", F.get("evidence", F.lit(1)).alias("count"))


def vector_reports(spark, sf_dir):
    """A report for the windows of each label, some of which can't be compared by rule, and one for all rows with the pairwise features."""
    windows = representation._windows(spark, sf_dir)
    label, current = F.col("label"), F.col("role") == "CURRENT"
    sides = windows.groupBy("label", "role").agg(F.count("*").alias("samples")).where(~((label == 2) & current))
    sides = sides.select(
        label.cast("string").alias("key"), "role", F.when(label == 4, 7).otherwise(F.col("samples")).alias("samples"), F.when((label == 5) & current, 2).otherwise(1).alias("schema_version"),
        F.when(label == 3, "PARTIAL").otherwise("COMPLETE").alias("status"), F.when((label == 1) & current, 32).otherwise(64).alias("dimension"), F.when((label == 0) & current, "b").otherwise("a").alias("space_id"),
    )
    whole = windows.groupBy("role").agg(F.count("*").alias("samples")).select(F.lit("all").alias("key"), "role", "samples", F.lit(1).alias("schema_version"), F.lit("COMPLETE").alias("status"), F.lit(64).alias("dimension"), F.lit("a").alias("space_id"))
    gates = compare.comparability(sides.union(whole), ("key",), compare.VECTOR_SPACE, partial_code=compare.VECTOR_PARTIAL)
    moved = vectors.moved(vectors.vector_profile(windows, ("label", "role"), "v"), ("label",))
    row = lambda df, key, feature, state: df.select(key.alias("key"), F.lit(feature).alias("feature"), F.col(state).alias("state"), F.array().cast("array<string>").alias("limitations"))
    parts = [row(moved, label.cast("string"), f, c) for f, c in zip(compare.VECTOR_FEATURES, ("centroid_state", "dispersion_state", "variance_state"))]
    parts += [row(vectors.mmd(windows, "vec_id", "v"), F.lit("all"), compare.VECTOR_FEATURES[3], "state"), row(vectors.nearest_support(windows, "vec_id", "v"), F.lit("all"), compare.VECTOR_FEATURES[4], "state")]
    found = compare.layer_report(gates, reduce(DataFrame.union, parts), ("key",), compare.VECTOR_FEATURES)
    return found.select("key", "status", *(F.array_join(c, ",").alias(c) for c in ("shifted", "stable", "partial", "unavailable", "incomparable", "limitations", "feature_limitations")))


def output_reports(spark, sf_dir):
    """Reports of predictions by customer segment and nation: features by rule, flags that were not declared, other output spaces."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("key"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    both = c.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    sides = both.groupBy("key", "n", "i").agg(F.count("*").alias("samples")).select(
        "key", F.when(F.col("i") == 1, "CURRENT").otherwise("REFERENCE").alias("role"), F.when(F.col("n") % 8 == 3, 3).otherwise(F.col("samples") + 20).alias("samples"), F.lit(1).alias("schema_version"),
        F.when(F.col("n") % 5 == 2, "PARTIAL").otherwise("COMPLETE").alias("status"), F.when((F.col("i") == 1) & (F.col("n") % 6 == 1), "b").otherwise("a").alias("space_id"),
    )
    gates = compare.comparability(sides, ("key",), compare.OUTPUT_SPACE, partial_code=compare.OUTPUT_PARTIAL)
    number = F.explode(F.sequence(F.lit(0), F.lit(len(compare.OUTPUT_FEATURES) - 1))).alias("f")
    features = c.groupBy("key", "n").agg(F.sum("k").alias("s")).select("key", "n", "s", number).where((F.col("n") % 2 == 0) | (F.col("f") < 4))
    named = F.get(F.array(*map(F.lit, compare.OUTPUT_FEATURES)), F.col("f"))
    rows = features.select("key", named.alias("feature"), F.when((F.col("s") + F.col("f")) % 3 == 0, "SHIFTED").otherwise("STABLE").alias("state"), F.array().cast("array<string>").alias("limitations"))
    undeclared = {f: "CALLER_DECLARED_FLAG_UNAVAILABLE" for f in compare.OUTPUT_FEATURES[4:]}
    found = compare.layer_report(gates, rows, ("key",), compare.OUTPUT_FEATURES, undeclared)
    return found.select("key", "status", *(F.array_join(c, ",").alias(c) for c in ("shifted", "stable", "partial", "unavailable", "incomparable", "limitations", "feature_limitations")))


#: From gates ``g`` (key, state, notes) and features ``ft`` (key, feature, state) to reports; ``fo``: (i, feature, code).
_REPORT = """q AS (SELECT g.key, i, fo.feature, g.state AS gate, notes, CASE WHEN g.state IN ('INCOMPARABLE', 'UNAVAILABLE') THEN g.state WHEN notes LIKE '%INSUFFICIENT%' THEN 'PARTIAL' ELSE coalesce(ft.state, 'UNAVAILABLE') END AS state,
  CASE WHEN g.state IN ('INCOMPARABLE', 'UNAVAILABLE') THEN notes WHEN notes LIKE '%INSUFFICIENT%' THEN 'INSUFFICIENT_SAMPLE_SUPPORT' WHEN ft.state IS NULL THEN code ELSE '' END AS own FROM g CROSS JOIN fo LEFT JOIN ft ON ft.key = g.key AND ft.feature = fo.feature),
rp AS (SELECT key, any_value(gate) AS gate, any_value(notes) AS limitations, count(*) FILTER (state NOT IN ('SHIFTED', 'STABLE')) AS bad,
  coalesce(string_agg(feature, ',' ORDER BY i) FILTER (state = 'SHIFTED'), '') AS shifted, coalesce(string_agg(feature, ',' ORDER BY i) FILTER (state = 'STABLE'), '') AS stable, coalesce(string_agg(feature, ',' ORDER BY i) FILTER (state = 'PARTIAL'), '') AS partial,
  coalesce(string_agg(feature, ',' ORDER BY i) FILTER (state = 'UNAVAILABLE'), '') AS unavailable, coalesce(string_agg(feature, ',' ORDER BY i) FILTER (state = 'INCOMPARABLE'), '') AS incomparable, string_agg(feature || ':' || own, ',' ORDER BY i) AS feature_limitations FROM q GROUP BY key)
SELECT key, CASE WHEN gate IN ('INCOMPARABLE', 'UNAVAILABLE') THEN gate WHEN limitations <> '' OR bad > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, shifted, stable, partial, unavailable, incomparable, array_to_string(list_sort(string_split(limitations, ',')), ',') AS limitations, feature_limitations FROM rp"""

_GRAPHS = """p AS (SELECT p_size AS model_id, p_partkey AS k, p_name, p_brand, p_size % 7 AS m FROM part),
ends AS (SELECT * FROM (SELECT model_id, m, CASE WHEN k % 2 = 0 THEN 'input' ELSE 'output' END AS direction, 't' || k AS name, CASE WHEN k % 11 = 0 THEN 'batch' WHEN k % 11 = 1 THEN '?' ELSE '64' END AS size FROM p WHERE k % 3 = 0)
  WHERE NOT (m = 1 AND direction = 'input') AND NOT (m = 2 AND direction = 'output')),
nodes AS (SELECT model_id, CASE WHEN k % 4 > 0 THEN 'n' || k ELSE k::VARCHAR END AS node, p_brand AS op_type, CASE WHEN k % 17 = 0 THEN 'custom.ops' ELSE '' END AS domain FROM p WHERE k % 3 = 1 AND m <> 3),
weights AS (SELECT model_id, k, CASE WHEN k % 13 > 0 THEN p_name ELSE '' END AS name, ['', '../up.bin', '/etc/x', 'c:/x', 'a/%2e%2e/b', 'data\\w.bin', 'http://h/x', 'w+1.bin'][k % 12 + 1] AS location,
  ['EXTERNAL_DATA_LOCATION_MISSING', 'EXTERNAL_DATA_PATH_UNSAFE', 'EXTERNAL_DATA_PATH_UNSAFE', 'EXTERNAL_DATA_PATH_UNSAFE', 'EXTERNAL_DATA_PATH_UNSAFE', 'EXTERNAL_DATA_NOT_VERIFIED', 'EXTERNAL_DATA_PATH_UNSAFE', 'EXTERNAL_DATA_NOT_VERIFIED'][k % 12 + 1] AS code FROM p WHERE k % 3 = 2)"""

_BEHAVIOUR = """b AS (SELECT s, p_size AS model_id, p_brand AS trigger_id, count(*) AS pairs, avg(p_partkey % 2) AS flip, avg(p_partkey % 5) / 10 AS lift, CASE WHEN min(p_partkey) % 4 > 0 THEN avg(p_partkey % 7) / 10 END AS control FROM part, range(0, 2) t(s) WHERE p_partkey % 3 <> s GROUP BY ALL),
d AS (SELECT x.model_id, x.trigger_id, CASE WHEN x.pairs = y.pairs THEN y.flip - x.flip END AS flip_change, CASE WHEN x.pairs = y.pairs THEN y.lift - x.lift END AS lift_change, CASE WHEN x.pairs = y.pairs THEN y.control - x.control END AS control_change
  FROM b x JOIN b y ON x.model_id = y.model_id AND x.trigger_id = y.trigger_id AND x.s = 0 AND y.s = 1)"""

QUERIES = {
    "structure_report": (
        structure_report,
        f"""WITH {_GRAPHS}, i AS (SELECT model_id, 'NO_GRAPH_INPUTS' AS code, '' AS evidence FROM (SELECT DISTINCT model_id FROM p) WHERE model_id NOT IN (SELECT model_id FROM ends WHERE direction = 'input')
UNION ALL SELECT model_id, 'NO_GRAPH_OUTPUTS', '' FROM (SELECT DISTINCT model_id FROM p) WHERE model_id NOT IN (SELECT model_id FROM ends WHERE direction = 'output')
UNION ALL SELECT model_id, 'EMPTY_GRAPH', '' FROM (SELECT DISTINCT model_id FROM p) WHERE model_id NOT IN (SELECT model_id FROM nodes)
UNION ALL SELECT model_id, 'DYNAMIC_OR_UNKNOWN_SHAPE', 'tensor=' || name || ';shape=[1, ' || size || ']' FROM ends WHERE size <> '64'
UNION ALL SELECT model_id, 'CUSTOM_OPERATOR_DOMAIN', 'node=' || node || ';domain=' || domain || ';op_type=' || op_type FROM nodes WHERE domain <> ''
UNION ALL SELECT model_id, 'OPERATOR_NOT_APPROVED', 'node=' || node || ';op_type=' || op_type FROM nodes WHERE NOT regexp_matches(op_type, '^Brand#[123][123]$')
UNION ALL SELECT model_id, code, concat_ws(';', 'initializer=' || name, CASE WHEN location <> '' THEN 'location=' || location END) FROM weights WHERE code IS NOT NULL
UNION ALL SELECT DISTINCT model_id, 'INITIALIZER_NAME_MISSING', '' FROM weights WHERE name = '')
SELECT model_id, code, CASE WHEN code IN ('CUSTOM_OPERATOR_DOMAIN', 'OPERATOR_NOT_APPROVED', 'EXTERNAL_DATA_NOT_VERIFIED', 'INITIALIZER_NAME_MISSING') THEN 'MEDIUM' WHEN code = 'DYNAMIC_OR_UNKNOWN_SHAPE' THEN 'LOW' ELSE 'HIGH' END AS severity, evidence FROM i""",
    ),
    "parameter_totals": (
        parameter_totals,
        f"WITH {_GRAPHS} SELECT model_id, count(*) AS n_initializers, sum((k % 1000) * (k % 7))::BIGINT AS n_parameters, CASE WHEN count(location) > 0 THEN 'EXTERNAL_DATA_UNVERIFIED' ELSE '-' END AS limitation FROM weights GROUP BY model_id",
    ),
    "tensor_flags": (
        tensor_flags,
        """WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, min(vec_id) OVER (PARTITION BY label) AS f FROM embeddings),
n AS (SELECT label, sqrt(list_dot_product(v, v)) * CASE WHEN vec_id = f AND label < 3 THEN 1000 WHEN label = 5 THEN 50 ELSE 1 END AS l2 FROM e),
s AS (SELECT label, max(l2) ^ 2 / sum(l2 ^ 2) AS top1, count(*) AS c, sqrt(sum(l2 ^ 2) / (64 * count(*))) AS rms FROM n GROUP BY label),
m AS (SELECT *, (SELECT median(rms) FROM s) AS mid FROM s), z AS (SELECT *, 0.6745 * (rms - mid) / (SELECT median(abs(rms - mid)) FROM m) AS z FROM m)
SELECT 't' || label AS tensor, 'PARAMETER_ENERGY_CONCENTRATION' AS code, 'MEDIUM' AS severity, 'channels=' || c AS count FROM s WHERE top1 >= 0.95 AND c >= 4
UNION ALL SELECT 't' || label, 'TENSOR_SCALE_OUTLIER', 'MEDIUM', 'peers=' || (SELECT count(*) FROM s) FROM z WHERE abs(z) >= 8""",
    ),
    "vector_reports": (
        vector_reports,
        f"""WITH vs AS ({representation.QUERIES["vector_shift"][1]}), vm AS ({representation.QUERIES["vector_mmd"][1]}), vn AS ({representation.QUERIES["vector_support"][1]}),
n AS (SELECT label, min(c) AS c, sum(c) AS s FROM (SELECT label, vec_id % 2 AS r, count(*) AS c FROM embeddings GROUP BY ALL) GROUP BY label),
g AS (SELECT label::VARCHAR AS key, CASE WHEN label = 2 THEN 'UNAVAILABLE' WHEN label IN (0, 1, 5) THEN 'INCOMPARABLE' WHEN label IN (3, 4) OR c < 20 THEN 'PARTIAL' ELSE 'COMPLETE' END AS state,
  CASE label WHEN 0 THEN 'REPRESENTATION_SPACE_MISMATCH' WHEN 1 THEN 'REPRESENTATION_DIMENSION_MISMATCH' WHEN 2 THEN 'INPUT_PROFILE_UNAVAILABLE' WHEN 5 THEN 'PROFILE_SCHEMA_INCOMPATIBLE'
    ELSE concat_ws(',', CASE WHEN label = 4 OR c < 20 THEN 'INSUFFICIENT_SAMPLE_SUPPORT' END, CASE WHEN label = 3 THEN 'INPUT_REPRESENTATION_PROFILE_PARTIAL' END) END AS notes FROM n UNION ALL SELECT 'all', 'COMPLETE', ''),
fo AS (SELECT i, feature, 'FEATURE_NOT_SUPPLIED' AS code FROM (VALUES {", ".join(f"({i}, '{f}')" for i, f in enumerate(compare.VECTOR_FEATURES))}) t(i, feature)),
ft AS (SELECT label::VARCHAR AS key, 'REPRESENTATION_CENTROID' AS feature, centroid_state AS state FROM vs UNION ALL SELECT label::VARCHAR, 'REPRESENTATION_DISPERSION', dispersion_state FROM vs UNION ALL SELECT label::VARCHAR, 'REPRESENTATION_VARIANCE', variance_state FROM vs
  UNION ALL SELECT 'all', 'REPRESENTATION_MMD', state FROM vm UNION ALL SELECT 'all', 'REPRESENTATION_SUPPORT_DISTANCE', state FROM vn), {_REPORT}""",
    ),
    "output_reports": (
        output_reports,
        f"""WITH n AS (SELECT c_nationkey AS n, sum(c_custkey) AS s FROM customer GROUP BY 1),
g AS (SELECT n::VARCHAR AS key, CASE WHEN n % 6 = 1 THEN 'INCOMPARABLE' WHEN n % 8 = 3 OR n % 5 = 2 THEN 'PARTIAL' ELSE 'COMPLETE' END AS state, CASE WHEN n % 6 = 1 THEN 'OUTPUT_SPACE_MISMATCH' ELSE concat_ws(',', CASE WHEN n % 8 = 3 THEN 'INSUFFICIENT_SAMPLE_SUPPORT' END, CASE WHEN n % 5 = 2 THEN 'INPUT_PREDICTION_PROFILE_PARTIAL' END) END AS notes FROM n),
fo AS (SELECT i, feature, CASE WHEN i < 4 THEN 'FEATURE_NOT_SUPPLIED' ELSE 'CALLER_DECLARED_FLAG_UNAVAILABLE' END AS code FROM (VALUES {", ".join(f"({i}, '{f}')" for i, f in enumerate(compare.OUTPUT_FEATURES))}) t(i, feature)),
ft AS (SELECT n::VARCHAR AS key, feature, CASE WHEN (s + i) % 3 = 0 THEN 'SHIFTED' ELSE 'STABLE' END AS state FROM n CROSS JOIN fo WHERE n % 2 = 0 OR i < 4), {_REPORT}""",
    ),
    "behaviour_deltas": (behaviour_deltas, f"WITH {_BEHAVIOUR} SELECT model_id, trigger_id, round(flip_change, 9) AS flip_change, round(lift_change, 9) AS lift_change, round(control_change, 9) AS control_change FROM d"),
    "behaviour_report": (
        behaviour_report,
        f"""WITH {_BEHAVIOUR}, i AS (SELECT DISTINCT s, p_size AS model_id, p_brand AS trigger_id, ['TRIGGER_SENSITIVITY', 'NONDETERMINISTIC_OUTPUT', 'OUTPUT_NONFINITE', 'TRIGGER_PREDICTION_FLIP'][p_partkey % 30 + 1] AS code FROM part, range(0, 2) t(s) WHERE p_partkey % 3 <> s AND p_partkey % 30 < 4),
c AS (SELECT model_id, trigger_id, code, CASE WHEN count(*) = 2 THEN 'PERSISTING' WHEN min(s) = 1 THEN 'NEW' ELSE 'RESOLVED' END AS delta FROM i GROUP BY ALL),
n AS (SELECT model_id, count(*) FILTER (delta = 'NEW') AS n_new, count(*) FILTER (delta = 'RESOLVED') AS n_resolved, count(*) FILTER (delta = 'PERSISTING') AS n_persisting,
  string_agg(DISTINCT name, ',' ORDER BY name) AS codes FROM (SELECT *, CASE WHEN code = 'TRIGGER_SENSITIVITY' THEN delta || '_' || code WHEN delta = 'NEW' AND code = 'NONDETERMINISTIC_OUTPUT' THEN 'NEW_NONDETERMINISM' WHEN delta = 'NEW' AND code = 'OUTPUT_NONFINITE' THEN 'NEW_OUTPUT_NONFINITE' END AS name FROM c) GROUP BY model_id),
r AS (SELECT model_id, count(*) FILTER (coalesce(flip_change, 0) <> 0 OR coalesce(lift_change, 0) <> 0 OR coalesce(control_change, 0) <> 0) AS moved FROM d GROUP BY model_id),
a AS (SELECT m.model_id, m.model_id % 9 = 0 OR m.model_id % 10 = 0 AS partial, coalesce(n_new, 0) AS n_new, coalesce(n_resolved, 0) AS n_resolved, coalesce(n_persisting, 0) AS n_persisting, coalesce(moved, 0) AS moved, coalesce(codes, '') AS codes FROM (SELECT DISTINCT p_size AS model_id FROM part) m LEFT JOIN n USING (model_id) LEFT JOIN r USING (model_id))
SELECT model_id, CASE WHEN partial THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, CASE WHEN partial THEN 'UNAVAILABLE' WHEN n_new + n_resolved + moved > 0 THEN 'CHANGED' ELSE 'SAME' END AS state, codes, n_new, n_resolved, n_persisting, CASE WHEN partial THEN 'BEHAVIORAL_EVIDENCE_PARTIAL' ELSE '' END AS limitations FROM a""",
    ),
}
