"""Catalogue: models, behaviour runs, receipts, registries, annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import annotations, models, registry, relational
from proofline.plans.derived import commitment_sql
from proofline.session import table
from proofline.streaming import acceptance


def _channels(spark, sf_dir):
    """Embeddings as tensors (label) of channels (vector id); some channels are dead or scaled by rule."""
    k = F.col("vec_id") % 97
    v = F.transform("embedding", lambda x: x.cast("double") * F.when(k == 5, 0.0).when(k == 7, 60.0).otherwise(1.0))
    return table(spark, sf_dir, "embeddings").select(F.lit("m").alias("model_id"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("tensor"), F.col("vec_id").alias("channel"), v.alias("values"))


def _values(spark, sf_dir):
    rows = _channels(spark, sf_dir).select("model_id", "tensor", F.explode("values").alias("value"), "channel")
    return rows.withColumn("value", F.when((F.col("tensor") == "t3") & (F.col("channel") % 50 == 3), F.lit(float("nan"))).when(F.col("tensor") == "t4", 0.0).when(F.col("tensor") == "t5", 2.5).otherwise(F.col("value")))


_STATS = ("minimum", "maximum", "mean", "std", "abs_max", "l1", "l2", "rms", "median", "mad", "zero_fraction", "near_zero_fraction")


def tensor_stats(spark, sf_dir):
    return models.tensor_stats(_values(spark, sf_dir)).select("tensor", "elements", "n_finite", "n_nan", *(F.round(c, 6).alias(c) for c in _STATS))


def tensor_issues(spark, sf_dir):
    return models.value_issues(models.tensor_stats(_values(spark, sf_dir))).select("tensor", "code", "severity")


def channel_outliers(spark, sf_dir):
    return models.channel_issues(models.channel_norms(_channels(spark, sf_dir))).select("tensor", "channel", "code", "severity")


def energy(spark, sf_dir):
    return models.energy(models.channel_norms(_channels(spark, sf_dir))).select("tensor", F.round("top1", 6).alias("top1"), F.round("topk", 6).alias("topk"), "n_channels", "concentrated")


def peer_scale(spark, sf_dir):
    stats = models.tensor_stats(_values(spark, sf_dir)).withColumns({"rank": F.lit(2), "dtype": F.lit("FLOAT")})
    return models.peer_scale(stats).select("tensor", "n_peers", F.round("rms", 6).alias("rms"), (F.round("robust_z", 5) + 0.0).alias("robust_z"), "is_outlier")


def bounded_issues(spark, sf_dir):
    norms = models.channel_norms(_channels(spark, sf_dir))
    every = models.channel_issues(norms).unionByName(models.value_issues(models.tensor_stats(_values(spark, sf_dir))))
    return models.bounded_issues(every, models.TensorPolicy(per_tensor=2, in_total=12)).select("tensor", F.coalesce("channel", F.lit(-1)).alias("channel"), "code", "truncated")


def tensor_commitments(spark, sf_dir):
    return models.commitments(_channels(spark, sf_dir))


def _parts(spark, sf_dir, changed: bool):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    if changed:
        p = p.where("p_partkey % 17 != 0").union(p.where("p_partkey % 19 = 1").withColumn("p_partkey", k + 10_000_000))
    dtype = F.when((k % 11 == 0) & F.lit(changed), "other").otherwise(F.col("p_brand"))
    shape = F.when((k % 13 == 0) & F.lit(changed), -1).otherwise(F.col("p_size"))
    value = F.when((k % 7 == 0) & F.lit(changed), "x").otherwise(F.col("p_name"))
    return p.select(k.cast("string").alias("name"), dtype.alias("dtype"), shape.alias("shape"), F.sha2(value, 256).alias("value_sha256"))


def parameter_diff(spark, sf_dir):
    return models.parameter_diff(_parts(spark, sf_dir, False), _parts(spark, sf_dir, True))


def snapshot_diff(spark, sf_dir):
    diff = relational.named_diff(_parts(spark, sf_dir, False), _parts(spark, sf_dir, True), ("name",), ("dtype", "shape", "value_sha256"))
    return diff.select("name", "change", F.array_join("columns", ",").alias("columns"))


def issue_deltas(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_type").alias("code"), F.col("p_brand").alias("tensor"), F.when(F.col("p_size") % 5 > 0, F.col("p_size")).alias("channel"), "p_partkey")
    found = models.issue_deltas(rows.where("p_partkey % 3 != 0"), rows.where("p_partkey % 3 != 1"))
    return found.select("code", "tensor", F.coalesce("channel", F.lit(-1)).alias("channel"), "delta")


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("model_id"), F.col("event_type").alias("op_type"), F.when(F.col("event_id") % 41 == 0, "custom.ops").otherwise("").alias("domain"))


def structure_rules(spark, sf_dir):
    return models.structure_issues(_nodes(spark, sf_dir), ("click", "view"))


def operator_profile(spark, sf_dir):
    return models.operator_profile(_nodes(spark, sf_dir))


def issue_findings(spark, sf_dir):
    nodes = models.structure_issues(_nodes(spark, sf_dir), ("click", "view"))
    rows = nodes.select(F.col("model_id").cast("string").alias("model_id"), "code", F.array(F.concat(F.lit("subject="), "subject"), F.concat(F.lit("api_key="), F.col("n").cast("string"))).alias("evidence"))
    return models.issue_findings(rows, 2).select("model_id", "category", "severity", "confidence", "recommendation")


def _runs(spark, sf_dir):
    """Clean runs are vectors; five triggers add to one of their dimensions."""
    base = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model_id"), F.col("vec_id").alias("sample_id"), F.transform("embedding", lambda x: x.cast("double") * 10).alias("output"))
    t = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("t")
    rows = base.select("*", t)
    lift = F.when(F.col("t") == 0, 9.0).when(F.col("t") == 4, 0.0).otherwise(F.col("t") * 0.8)
    moved = F.transform("output", lambda x, i: F.when(i == 2, x + lift).otherwise(x))
    triggered = rows.select("model_id", "sample_id", moved.alias("output"), F.concat(F.lit("p"), F.col("t").cast("string")).alias("trigger_id"), F.lit("solid").alias("kind"), F.concat(F.lit("loc"), F.col("t").cast("string")).alias("location"), F.lit(2).alias("ph"), F.lit(2).alias("pw"))
    return base, triggered


def trigger_behaviour(spark, sf_dir):
    found = models.control_relative(models.trigger_behaviour(*_runs(spark, sf_dir)))
    return found.select("model_id", "trigger_id", "pairs", "flips", "dominant", *(F.round(c, 6).alias(c) for c in ("flip_rate", "dominant_rate", "clean_rate", "lift", "mean_delta", "control_relative")))


def trigger_issues(spark, sf_dir):
    return models.behaviour_issues(models.control_relative(models.trigger_behaviour(*_runs(spark, sf_dir))))


def run_status(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("model_id"), F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderkey") % 9 == 0, "TIMEOUT").otherwise("OK").alias("status"))
    return models.run_coverage(runs)


def output_contract(spark, sf_dir):
    runs = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model_id"), "vec_id", F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 10 == 1, F.transform("embedding", lambda x: F.lit(float("inf")).cast("float"))).otherwise(F.col("embedding")).alias("output"))
    contracts = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model_id")).distinct().where("model_id != 'm2'").withColumn("expected_size", F.lit(64))
    return models.output_contract(runs, contracts).select("vec_id", F.coalesce("code", F.lit("-")).alias("code"), "nonfinite")


def _receipts(spark, sf_dir):
    """Receipts by user: the sequence is the rank with repeats, the nonce is reused by rule, some come late."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    lag = F.when(F.col("event_id") % 31 == 0, 400).when(F.col("event_id") % 37 == 0, -60).otherwise(5)
    return e.select(
        F.col("user_id").cast("string").alias("stream_key"),
        F.col("event_id").alias("receipt_id"),
        F.sha2(F.concat_ws("|", F.when(F.col("n") % 13 == 0, F.col("n") - 1).otherwise(F.col("n")).cast("string"), F.col("user_id").cast("string")), 256).alias("receipt_hash"),
        F.concat(F.lit("n"), F.when(F.col("n") % 11 == 0, F.col("n") - 2).otherwise(F.col("n")).cast("string")).alias("nonce"),
        F.when(F.col("n") % 7 == 0, F.col("n") - 3).otherwise(F.col("n")).cast("long").alias("sequence"),
        (F.col("ts").cast("timestamp") - F.make_dt_interval(secs=lag)).alias("issued_at"),
        F.col("ts").cast("timestamp").alias("received_at"),
        (F.col("event_id") % 29 != 0).alias("checks_valid"),
    )


def receipt_accept(spark, sf_dir):
    return acceptance.classify(acceptance.accept_batch(_receipts(spark, sf_dir))).select("stream_key", "receipt_id", "status", "reasons", "event")


def receipt_verify(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_id") % 23 != 0, F.col("props")).alias("input"), F.sha2(F.when(F.col("event_id") % 10 == 0, F.lit("other")).otherwise(F.col("props")), 256).alias("input_hash"), F.col("event_type").alias("output"), F.sha2("event_type", 256).alias("output_hash"), F.when(F.col("event_id") % 50 != 0, F.col("event_id") % 45 != 0).alias("signature_valid"))
    return acceptance.verify(rows, ("input", "output")).select("event_id", F.element_at("checks", "input").alias("input_check"), F.element_at("checks", "signature").alias("signature_check"), "status")


def registry_verify(spark, sf_dir):
    reg = table(spark, sf_dir, "part").where("p_partkey % 10 != 3").select(F.col("p_partkey").alias("model_id"), F.sha2("p_name", 256).alias("digest"), F.when(F.col("p_size") % 9 == 0, "REVOKED").when(F.col("p_size") % 9 == 1, "QUARANTINED").otherwise("APPROVED").alias("state"))
    seen = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("model_id"), "l_orderkey", "l_linenumber", F.sha2(F.when(F.col("l_orderkey") % 100 == 0, "swapped").otherwise(F.col("p_name")), 256).alias("digest"))
    return registry.verify_models(seen, reg).groupBy(F.coalesce("finding", F.lit("-")).alias("finding"), "verdict").agg(F.count("*").alias("n"), F.countDistinct("model_id").alias("models"))


def run_authorise(spark, sf_dir):
    producers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("producer_id"), F.concat(F.lit("mod"), (F.col("s_nationkey") % 4).cast("string")).alias("module"), F.when(F.col("s_suppkey") % 7 == 0, "SUSPENDED").otherwise("APPROVED").alias("state"))
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key_id"), (F.col("p_partkey") % 100).alias("producer_id"), F.when(F.col("p_size") % 6 == 0, "REVOKED").otherwise("ACTIVE").alias("state"), F.col("p_brand").alias("fingerprint"))
    runs = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 110).alias("producer_id"), F.concat(F.lit("mod"), (F.col("l_linenumber") % 4).cast("string")).alias("module"), F.when(F.col("l_orderkey") % 4 == 0, F.col("l_suppkey") % 110 + 100 * (F.col("l_linenumber") % 3)).otherwise(F.col("l_partkey") * 2).alias("key_id"), F.concat(F.lit("Brand#"), (F.col("l_linenumber") % 5 + 1).cast("string")).alias("fingerprint"))
    return registry.authorise(runs, producers, keys).groupBy(F.coalesce("denial", F.lit("-")).alias("denial")).agg(F.count("*").alias("n"))


def _submitted(spark, sf_dir):
    """A run for each customer; two neighbouring orders share a finding."""
    return table(spark, sf_dir, "orders").select((F.col("o_custkey")).alias("run_id"), F.concat(F.lit("F-"), F.expr("o_orderkey div 2").cast("string")).alias("finding_id"), F.when(F.col("o_orderkey") % 500 == 0, "changed").otherwise(F.col("o_orderpriority")).alias("content"))


def _stored(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("F-"), F.expr("o_orderkey div 2").cast("string")).alias("finding_id"), F.col("o_orderpriority").alias("content"))


def idempotent_ingest(spark, sf_dir):
    return relational.ingest_status(_submitted(spark, sf_dir), _stored(spark, sf_dir), "finding_id", "content").groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("finding_id").alias("ids"))


def run_ingest(spark, sf_dir):
    return registry.ingest_runs(_submitted(spark, sf_dir), _stored(spark, sf_dir)).groupBy("accepted").agg(F.count("*").alias("runs"), F.sum(F.col("created") + F.col("existing") + F.col("conflicts")).alias("findings"))


def assessment_lifecycle(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    log = o.select((F.col("o_custkey")).alias("assessment_id"), F.col("o_orderkey").alias("at"), F.element_at(F.array(F.lit("DRAFT"), F.lit("ACTIVE"), F.lit("SEALED")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("state"))
    return registry.lifecycle(log).select("assessment_id", "at", "state", F.coalesce("before", F.lit("-")).alias("before"), "is_legal")


def _members(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("assessment_id"), F.col("o_orderkey").alias("run_id"), F.sha2(F.col("o_orderpriority"), 256).alias("request_hash"), F.when(F.col("o_orderstatus") == "F", "SIGNED").otherwise("TOKEN").alias("mode"))


def seal_verify(spark, sf_dir):
    sealed = registry.seal(_members(spark, sf_dir))
    now = _members(spark, sf_dir).withColumn("mode", F.when(F.col("run_id") % 400 == 0, "EDITED").otherwise(F.col("mode")))
    return registry.verify_seals(sealed, now).select("assessment_id", "runs", "run_set_hash", "status")


def assurance_edges(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("F"), F.col("l_linenumber").cast("string")).alias("finding_id"))
    return registry.edges(_members(spark, sf_dir), found)


def run_details(spark, sf_dir):
    m = _members(spark, sf_dir)
    found = registry.run_details(m.select("run_id"), m.where("run_id % 5 != 0"), m.where("run_id % 11 != 0"))
    return found.select("run_id", F.coalesce("assessment_id", F.lit(-1)).alias("assessment_id"), "authenticated", F.coalesce("error", F.lit("-")).alias("error"))


def annotation_violations(spark, sf_dir):
    o, p, l = (table(spark, sf_dir, t) for t in ("orders", "part", "lineitem"))
    images = o.where("o_orderkey % 50 != 1").select(F.col("o_orderkey").alias("id")).union(o.where("o_orderkey % 1000 = 0").select("o_orderkey"))
    notes = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("category_id"))
    return annotations.reference_violations(images, p.where("p_partkey % 97 != 5").select(F.col("p_partkey").alias("id")), notes).groupBy("violation").agg(F.count("*").alias("subjects"), F.sum("n").alias("n"))


def box_violations(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    images = o.select(F.col("o_orderkey").alias("id"), F.lit(50.0).alias("width"), F.lit(40.0).alias("height"))
    box = F.array((F.col("l_quantity") - 2), F.col("l_discount") * 100, F.col("l_quantity") / 2 - 1, F.col("l_tax") * 400)
    notes = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("image_id"), F.when(F.col("l_partkey") % 100 == 0, F.slice(box, 1, 3)).otherwise(box).alias("bbox"))
    return annotations.box_violations(notes, images).groupBy("problem").agg(F.count("*").alias("n"))


def label_lines(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    n = lambda c: F.format_string("%.2f", c)
    line = F.concat_ws(" ", (F.col("l_linenumber") + F.when(F.col("l_partkey") % 50 == 0, 20).otherwise(0)).cast("string"), n(F.col("l_discount") * 5), n(F.col("l_tax") * 11), F.when(F.col("l_partkey") % 77 == 0, "wide").otherwise(n(F.col("l_quantity") / 52)), F.when(F.col("l_partkey") % 41 != 0, "0.5"))
    found = annotations.parse_label_lines(l.select(line.alias("line")), 8)
    return found.groupBy(F.coalesce("problem", F.lit("-")).alias("problem")).agg(F.count("*").alias("n"), F.coalesce(F.sum("class_id"), F.lit(0)).alias("classes"))


_CH = "ch AS (SELECT 't' || label AS tensor, vec_id AS channel, list_transform(embedding, lambda x: x::DOUBLE * CASE vec_id % 97 WHEN 5 THEN 0.0 WHEN 7 THEN 60.0 ELSE 1.0 END) AS v FROM embeddings)"
_VAL = (
    _CH
    + """, val AS (SELECT tensor, channel, CASE WHEN tensor = 't3' AND channel % 50 = 3 THEN 'nan'::DOUBLE WHEN tensor = 't4' THEN 0.0 WHEN tensor = 't5' THEN 2.5 ELSE x END AS value FROM (SELECT tensor, channel, unnest(v) AS x FROM ch)),
a AS (SELECT tensor, count(*) AS elements, count(*) FILTER (NOT isnan(value)) AS n_finite, count(*) FILTER (isnan(value)) AS n_nan, min(value) FILTER (NOT isnan(value)) AS minimum, max(value) FILTER (NOT isnan(value)) AS maximum, avg(value) FILTER (NOT isnan(value)) AS mean, stddev_pop(value) FILTER (NOT isnan(value)) AS std,
  max(abs(value)) FILTER (NOT isnan(value)) AS abs_max, sum(abs(value)) FILTER (NOT isnan(value)) AS l1, sqrt(sum(value * value) FILTER (NOT isnan(value))) AS l2, sqrt(avg(value * value) FILTER (NOT isnan(value))) AS rms, quantile_cont(value, 0.5) FILTER (NOT isnan(value)) AS median,
  avg((value = 0)::INT) FILTER (NOT isnan(value)) AS zero_fraction, avg((abs(value) <= 1e-8)::INT) FILTER (NOT isnan(value)) AS near_zero_fraction FROM val GROUP BY tensor),
st AS (SELECT a.*, m.mad FROM a JOIN (SELECT val.tensor, quantile_cont(abs(value - median), 0.5) AS mad FROM val JOIN a ON a.tensor = val.tensor WHERE NOT isnan(value) GROUP BY val.tensor) m USING (tensor)),
vi AS (SELECT tensor, unnest(list_filter([CASE WHEN n_nan > 0 THEN 'PARAMETER_NAN' END, CASE WHEN n_nan = 0 AND abs_max = 0 THEN 'ALL_ZERO_TENSOR' END, CASE WHEN n_nan = 0 AND abs_max > 0 AND minimum = maximum THEN 'CONSTANT_TENSOR' END, CASE WHEN NOT (n_nan = 0 AND abs_max = 0) AND zero_fraction >= 0.99 THEN 'EXTREME_ZERO_FRACTION' END], lambda x: x IS NOT NULL)) AS code FROM st)"""
)
_NORM = (
    _CH
    + """, n AS (SELECT tensor, channel, sqrt(list_dot_product(v, v)) AS l2 FROM ch), md AS (SELECT tensor, quantile_cont(l2, 0.5) AS m, count(*) AS k FROM n GROUP BY tensor),
d AS (SELECT n.tensor, quantile_cont(abs(l2 - m), 0.5) AS d FROM n JOIN md ON md.tensor = n.tensor GROUP BY n.tensor),
z AS (SELECT n.*, CASE WHEN d > 0 THEN 0.6745 * (l2 - m) / d ELSE 0 END AS z, l2 / m AS ratio FROM n JOIN md USING (tensor) JOIN d USING (tensor)),
ci AS (SELECT tensor, channel, unnest(list_filter([CASE WHEN l2 = 0 THEN 'DEAD_CHANNEL' END, CASE WHEN l2 > 0 AND abs(z) >= 8 THEN 'CHANNEL_NORM_OUTLIER' END, CASE WHEN ratio >= 20 THEN 'EXTREME_CHANNEL_SCALE' END], lambda x: x IS NOT NULL)) AS code FROM z)"""
)
_SEV = "CASE WHEN code IN ('PARAMETER_NAN', 'EXTREME_CHANNEL_SCALE') THEN 'HIGH' WHEN code IN ('CONSTANT_TENSOR', 'EXTREME_ZERO_FRACTION') THEN 'LOW' ELSE 'MEDIUM' END"
_PARTS = """
o AS (SELECT p_partkey::VARCHAR AS name, p_brand AS dtype, p_size AS shape, p_name AS v FROM part),
q AS (SELECT p_partkey AS k, p_brand, p_size, p_name FROM part WHERE p_partkey % 17 <> 0 UNION ALL SELECT p_partkey + 10000000, p_brand, p_size, p_name FROM part WHERE p_partkey % 19 = 1),
w AS (SELECT k::VARCHAR AS name, CASE WHEN k % 11 = 0 THEN 'other' ELSE p_brand END AS dtype, CASE WHEN k % 13 = 0 THEN -1 ELSE p_size END AS shape, CASE WHEN k % 7 = 0 THEN 'x' ELSE p_name END AS v FROM q),
j AS (SELECT coalesce(o.name, w.name) AS name, o.name IS NULL AS added, w.name IS NULL AS removed, o.dtype <> w.dtype AS d, o.shape <> w.shape AS s, o.v <> w.v AS x FROM o FULL JOIN w ON o.name = w.name)"""
_NODES = "nd AS (SELECT user_id % 20 AS model_id, event_type AS op_type, CASE WHEN event_id % 41 = 0 THEN 'custom.ops' ELSE '' END AS domain FROM events), si AS (SELECT model_id, 'CUSTOM_OPERATOR_DOMAIN' AS code, domain AS subject, count(*) AS n FROM nd WHERE domain <> '' GROUP BY ALL UNION ALL SELECT model_id, 'OPERATOR_NOT_APPROVED', op_type, count(*) FROM nd WHERE op_type NOT IN ('click', 'view') GROUP BY ALL)"
_BEH = """
b AS (SELECT 'm' || (label % 3) AS model_id, vec_id, list_transform(embedding, lambda x: x::DOUBLE * 10) AS o FROM embeddings),
t AS (SELECT model_id, vec_id, t, o, list_transform(o, lambda x, i: CASE WHEN i = 3 THEN x + CASE t WHEN 0 THEN 9.0 WHEN 4 THEN 0.0 ELSE t * 0.8 END ELSE x END) AS w FROM b, range(0, 5) r(t)),
c AS (SELECT *, list_position(o, list_max(o)) - 1 AS c0, list_position(w, list_max(w)) - 1 AS c1, list_distance(o, w) / sqrt(list_dot_product(o, o)) AS d FROM t),
g AS (SELECT model_id, t, count(*) AS pairs, count(*) FILTER (c0 <> c1) AS flips, avg(d) AS mean_delta FROM c GROUP BY ALL),
v AS (SELECT model_id, t, c1, count(*) AS k FROM c GROUP BY ALL),
m AS (SELECT DISTINCT ON (model_id, t) model_id, t, c1 AS dominant, k FROM v ORDER BY model_id, t, k DESC, c1),
h AS (SELECT g.*, dominant, flips / pairs AS flip_rate, k / pairs AS dominant_rate, (SELECT count(*) FROM c WHERE c.model_id = g.model_id AND c.t = 0 AND c0 = dominant) / pairs AS clean_rate FROM g JOIN m USING (model_id, t)),
r AS (SELECT h.*, dominant_rate - clean_rate AS lift, flip_rate - (SELECT quantile_cont(p.flip_rate, 0.5) FROM h p WHERE p.model_id = h.model_id AND p.t <> h.t) AS control_relative FROM h)"""
_MEM = "me AS (SELECT o_custkey AS assessment_id, o_orderkey AS run_id, sha256(o_orderpriority) AS request_hash, CASE WHEN o_orderstatus = 'F' THEN 'SIGNED' ELSE 'TOKEN' END AS mode FROM orders)"
_SUB = "su AS (SELECT o_custkey AS run_id, 'F-' || (o_orderkey // 2) AS finding_id, CASE WHEN o_orderkey % 500 = 0 THEN 'changed' ELSE o_orderpriority END AS content FROM orders), sd AS (SELECT 'F-' || (o_orderkey // 2) AS finding_id, o_orderpriority AS stored FROM orders WHERE o_orderkey % 3 = 0)"
_STATUS = "rk AS (SELECT x.*, min(content) OVER (PARTITION BY finding_id) AS f, row_number() OVER (PARTITION BY finding_id ORDER BY content, run_id) AS n FROM {x} x), sg AS (SELECT rk.*, CASE WHEN content <> coalesce(stored, f) THEN 'CONFLICT' WHEN stored IS NOT NULL OR n > 1 THEN 'EXISTS' ELSE 'CREATED' END AS status FROM rk LEFT JOIN sd USING (finding_id))"

#: Receipts one by one by arrival: each step of the recursion takes the next receipt of every key.
FOLD = """RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
q AS (SELECT user_id::VARCHAR AS stream_key, event_id, n, sha256((CASE WHEN n % 13 = 0 THEN n - 1 ELSE n END) || '|' || user_id) AS h, 'n' || (CASE WHEN n % 11 = 0 THEN n - 2 ELSE n END) AS nonce,
  CASE WHEN n % 7 = 0 THEN n - 3 ELSE n END AS s, CASE WHEN event_id % 31 = 0 THEN 400 WHEN event_id % 37 = 0 THEN -60 ELSE 5 END AS age, event_id % 29 <> 0 AS ok FROM e),
f AS (SELECT DISTINCT stream_key, 0::BIGINT AS n, NULL::BIGINT AS receipt_id, []::VARCHAR[] AS nonces, []::VARCHAR[] AS hashes, NULL::BIGINT AS top, NULL::VARCHAR AS reasons FROM q
  UNION ALL SELECT stream_key, n, receipt_id, CASE WHEN r = '' THEN list_append(nonces, nonce) ELSE nonces END, CASE WHEN r = '' THEN list_append(hashes, h) ELSE hashes END, CASE WHEN r = '' THEN s ELSE top END, r FROM (
    SELECT f.stream_key, q.n, q.event_id AS receipt_id, nonces, hashes, top, nonce, h, s, concat_ws(',', CASE WHEN NOT ok THEN 'CHECKS_INVALID' END, CASE WHEN age > 300 THEN 'STALE_RECEIPT' WHEN age < -30 THEN 'FUTURE_TIMESTAMP' END, CASE WHEN list_contains(nonces, nonce) THEN 'NONCE_REUSE' END,
      CASE WHEN list_contains(hashes, h) THEN 'REPLAY_DETECTED' END, CASE WHEN s = top THEN 'DUPLICATE_SEQUENCE' WHEN s < top THEN 'SEQUENCE_REGRESSION' END) AS r FROM f JOIN q ON q.stream_key = f.stream_key AND q.n = f.n + 1)),
w AS (SELECT stream_key, receipt_id, CASE WHEN reasons = '' THEN 'ACCEPT' ELSE 'REJECT' END AS status, reasons FROM f WHERE n > 0)"""
ACCEPTED = f"WITH {FOLD} SELECT *, CASE WHEN status = 'ACCEPT' THEN 'RECEIPT_ACCEPTED' WHEN reasons LIKE '%REPLAY%' OR reasons LIKE '%NONCE%' THEN 'REPLAY_ATTEMPT' WHEN reasons LIKE '%CHECKS%' THEN 'VERIFICATION_FAILED' ELSE 'RECEIPT_REFUSED' END AS event FROM w"

QUERIES = {
    "tensor_stats": (tensor_stats, f"WITH {_VAL} SELECT tensor, elements, n_finite, n_nan, " + ", ".join(f"round({c}, 6) AS {c}" for c in _STATS) + " FROM st"),
    "tensor_issues": (tensor_issues, f"WITH {_VAL} SELECT tensor, code, {_SEV} AS severity FROM vi"),
    "channel_outliers": (channel_outliers, f"WITH {_NORM} SELECT tensor, channel, code, {_SEV} AS severity FROM ci"),
    "energy": (energy, f"WITH {_NORM}, e AS (SELECT tensor, l2 * l2 AS e, row_number() OVER (PARTITION BY tensor ORDER BY l2 DESC, channel) AS r FROM n), s AS (SELECT tensor, sum(e) FILTER (r <= 1) / sum(e) AS top1, sum(e) FILTER (r <= 3) / sum(e) AS topk, count(*) AS n_channels FROM e GROUP BY tensor) SELECT tensor, round(top1, 6) AS top1, round(topk, 6) AS topk, n_channels, top1 >= 0.95 AND n_channels >= 4 AS concentrated FROM s"),
    "peer_scale": (peer_scale, f"WITH {_VAL}, pm AS (SELECT quantile_cont(rms, 0.5) AS m, count(*) AS n_peers FROM st), pd AS (SELECT quantile_cont(abs(rms - m), 0.5) AS d FROM st, pm) SELECT tensor, n_peers, round(rms, 6) AS rms, round(0.6745 * (rms - m) / d, 5) + 0.0 AS robust_z, abs(0.6745 * (rms - m) / d) >= 8 AS is_outlier FROM st, pm, pd"),
    "bounded_issues": (
        bounded_issues,
        f"WITH {_VAL}, {_NORM[len(_CH) + 2:]}, al AS (SELECT tensor, channel, code FROM ci UNION ALL SELECT tensor, NULL, code FROM vi), sv AS (SELECT *, CASE {_SEV} WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS s FROM al), r1 AS (SELECT *, row_number() OVER (PARTITION BY tensor ORDER BY s DESC, code, channel NULLS FIRST) AS r FROM sv), r2 AS (SELECT *, row_number() OVER (ORDER BY s DESC, code, tensor, channel NULLS FIRST) AS t FROM r1 WHERE r <= 2), r3 AS (SELECT * FROM r2 WHERE t <= 12) SELECT tensor, coalesce(channel, -1) AS channel, code, (SELECT count(*) FROM al) > (SELECT count(*) FROM r3) AS truncated FROM r3",
    ),
    "tensor_commitments": (tensor_commitments, None),
    "parameter_diff": (parameter_diff, f"WITH {_PARTS} SELECT name, CASE WHEN added THEN 'ADDED' WHEN removed THEN 'REMOVED' WHEN d THEN 'DTYPE_CHANGED' WHEN s THEN 'SHAPE_CHANGED' ELSE 'VALUE_CHANGED' END AS change FROM j WHERE added OR removed OR d OR s OR x"),
    "snapshot_diff": (snapshot_diff, f"WITH {_PARTS} SELECT name, CASE WHEN added THEN 'ADDED' WHEN removed THEN 'REMOVED' ELSE 'CHANGED' END AS change, concat_ws(',', CASE WHEN d THEN 'dtype' END, CASE WHEN s THEN 'shape' END, CASE WHEN x THEN 'value_sha256' END) AS columns FROM j WHERE added OR removed OR d OR s OR x"),
    "issue_deltas": (issue_deltas, "WITH r AS (SELECT p_type AS code, p_brand AS tensor, CASE WHEN p_size % 5 > 0 THEN p_size ELSE -1 END AS channel, bool_or(p_partkey % 3 <> 0) AS b, bool_or(p_partkey % 3 <> 1) AS a FROM part GROUP BY ALL) SELECT code, tensor, channel, CASE WHEN NOT b THEN 'NEW' WHEN NOT a THEN 'RESOLVED' ELSE 'PERSISTING' END AS delta FROM r"),
    "structure_rules": (structure_rules, f"WITH {_NODES} SELECT * FROM si"),
    "operator_profile": (operator_profile, f"WITH {_NODES} SELECT model_id, op_type, n, count(*) OVER (PARTITION BY model_id) AS n_operators FROM (SELECT model_id, op_type, count(*) AS n FROM nd GROUP BY ALL)"),
    "issue_findings": (
        issue_findings,
        f"WITH {_NODES}, x AS (SELECT model_id, code, CASE code WHEN 'CUSTOM_OPERATOR_DOMAIN' THEN 3 ELSE 2 END AS s, row_number() OVER (PARTITION BY model_id ORDER BY CASE code WHEN 'CUSTOM_OPERATOR_DOMAIN' THEN 3 ELSE 2 END DESC) AS r, count(*) OVER (PARTITION BY model_id) AS n FROM si) SELECT model_id::VARCHAR AS model_id, code AS category, CASE s WHEN 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE s WHEN 3 THEN 0.98 ELSE 0.95 END::DOUBLE AS confidence, CASE s WHEN 3 THEN 'QUARANTINE' ELSE 'REVIEW' END AS recommendation FROM x WHERE r <= 2 UNION ALL SELECT model_id::VARCHAR, 'FINDING_MAPPING_TRUNCATED', 'LOW', 1.0, 'REVIEW' FROM x WHERE r = 2 AND n > 2",
    ),
    "trigger_behaviour": (trigger_behaviour, f"WITH {_BEH} SELECT model_id, 'p' || t AS trigger_id, pairs, flips, dominant, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("flip_rate", "dominant_rate", "clean_rate", "lift", "mean_delta", "control_relative")) + " FROM r"),
    "trigger_issues": (trigger_issues, f"WITH {_BEH} SELECT model_id, 'p' || t AS trigger_id, unnest(list_filter([CASE WHEN mean_delta >= 10 THEN 'TRIGGER_OUTPUT_DIVERGENCE' END, CASE WHEN flip_rate >= 0.75 THEN 'TRIGGER_PREDICTION_FLIP' END, CASE WHEN dominant_rate >= 0.75 AND lift >= 0.5 THEN 'TRIGGER_TARGET_CONCENTRATION' END, CASE WHEN flip_rate >= 0.75 AND dominant_rate >= 0.75 AND lift >= 0.5 AND control_relative >= 0.5 THEN 'TRIGGER_SENSITIVITY' END], lambda x: x IS NOT NULL)) AS code FROM r WHERE pairs >= 8"),
    "run_status": (run_status, "WITH r AS (SELECT o_custkey % 40 AS model_id, CASE WHEN o_orderstatus = 'F' THEN 'FAILED' WHEN o_orderkey % 9 = 0 THEN 'TIMEOUT' ELSE 'OK' END AS s FROM orders), a AS (SELECT model_id, count(*) AS requested, count(*) FILTER (s = 'OK') AS usable, count(*) FILTER (s = 'FAILED') AS failed, count(*) FILTER (s = 'TIMEOUT') AS timed_out FROM r GROUP BY ALL) SELECT *, CASE WHEN usable = 0 THEN 'UNAVAILABLE' WHEN usable < requested THEN 'PARTIAL' ELSE 'COMPLETE' END AS analysis FROM a"),
    "output_contract": (output_contract, "SELECT vec_id, CASE WHEN label % 3 = 2 OR vec_id % 10 = 0 THEN 'OUTPUT_CONTRACT_CHANGED' ELSE '-' END AS code, vec_id % 10 = 1 AS nonfinite FROM embeddings"),
    "receipt_accept": (receipt_accept, ACCEPTED),
    "receipt_verify": (receipt_verify, "WITH c AS (SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'UNAVAILABLE' WHEN event_id % 10 = 0 THEN 'INVALID' ELSE 'VALID' END AS input_check, CASE WHEN event_id % 50 = 0 OR event_id % 45 = 0 THEN 'INVALID' ELSE 'VALID' END AS signature_check FROM events) SELECT *, CASE WHEN 'INVALID' IN (input_check, signature_check) THEN 'REJECT' WHEN input_check = 'UNAVAILABLE' THEN 'REVIEW' ELSE 'ACCEPT' END AS status FROM c"),
    "registry_verify": (
        registry_verify,
        "WITH c AS (SELECT l_partkey, CASE WHEN p_partkey % 10 = 3 THEN 'MODEL_UNREGISTERED' WHEN l_orderkey % 100 = 0 THEN 'MODEL_SUBSTITUTION' WHEN p_size % 9 = 0 THEN 'MODEL_REVOKED' WHEN p_size % 9 = 1 THEN 'MODEL_QUARANTINED' END AS f FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT coalesce(f, '-') AS finding, CASE WHEN f IS NULL THEN 'ACCEPT' WHEN f = 'MODEL_UNREGISTERED' THEN 'REVIEW' WHEN f = 'MODEL_QUARANTINED' THEN 'QUARANTINE' ELSE 'REJECT' END AS verdict, count(*) AS n, count(DISTINCT l_partkey) AS models FROM c GROUP BY ALL",
    ),
    "run_authorise": (
        run_authorise,
        "WITH r AS (SELECT l_suppkey % 110 AS p, 'mod' || (l_linenumber % 4) AS module, CASE WHEN l_orderkey % 4 = 0 THEN l_suppkey % 110 + 100 * (l_linenumber % 3) ELSE l_partkey * 2 END AS k, 'Brand#' || (l_linenumber % 5 + 1) AS f FROM lineitem) SELECT CASE WHEN s_suppkey IS NULL THEN 'PRODUCER_UNKNOWN' WHEN s_suppkey % 7 = 0 THEN 'PRODUCER_NOT_APPROVED' WHEN module <> 'mod' || (s_nationkey % 4) THEN 'MODULE_MISMATCH' WHEN p_partkey IS NULL THEN 'KEY_UNKNOWN' WHEN p_partkey % 100 <> p THEN 'KEY_NOT_OWNED' WHEN p_size % 6 = 0 THEN 'KEY_NOT_ACTIVE' WHEN p_brand <> f THEN 'FINGERPRINT_MISMATCH' ELSE '-' END AS denial, count(*) AS n FROM r LEFT JOIN supplier ON s_suppkey = p LEFT JOIN part ON p_partkey = k GROUP BY 1",
    ),
    "idempotent_ingest": (idempotent_ingest, f"WITH {_SUB}, {_STATUS.format(x='su')} SELECT status, count(*) AS n, count(DISTINCT finding_id) AS ids FROM sg GROUP BY status"),
    "run_ingest": (run_ingest, f"WITH {_SUB}, {_STATUS.format(x='su')}, g AS (SELECT run_id, count(*) AS k, bool_or(status = 'CONFLICT') AS c FROM sg GROUP BY run_id) SELECT NOT c AS accepted, count(*) AS runs, sum(k)::BIGINT AS findings FROM g GROUP BY 1"),
    "assessment_lifecycle": (assessment_lifecycle, "WITH l AS (SELECT o_custkey AS assessment_id, o_orderkey AS a_t, ['DRAFT', 'ACTIVE', 'SEALED'][o_orderkey % 3 + 1] AS state FROM orders), b AS (SELECT *, lag(state) OVER (PARTITION BY assessment_id ORDER BY a_t) AS p FROM l) SELECT assessment_id, a_t AS \"at\", state, coalesce(p, '-') AS before, (p IS NULL AND state = 'DRAFT') OR coalesce(p = 'DRAFT' AND state = 'ACTIVE', false) OR coalesce(p = 'ACTIVE' AND state = 'SEALED', false) AS is_legal FROM b"),
    "seal_verify": (
        seal_verify,
        f"""WITH {_MEM}, {commitment_sql("me", "assessment_id", "run_id || '|' || request_hash || '|' || mode")}, e AS (SELECT assessment_id, bool_or(run_id % 400 = 0) AS e FROM me GROUP BY 1)
        SELECT assessment_id, samples AS runs, commitment AS run_set_hash, CASE WHEN e THEN 'COMPROMISED' ELSE 'VALID' END AS status FROM hash_tree JOIN e USING (assessment_id)""",
    ),
    "assurance_edges": (assurance_edges, "SELECT o_custkey::VARCHAR AS src, o_orderkey::VARCHAR AS dst, 'HAS_RUN' AS relation FROM orders UNION SELECT l_orderkey::VARCHAR, 'F' || l_linenumber, 'REPORTED' FROM lineitem"),
    "run_details": (run_details, f"WITH {_MEM} SELECT run_id, CASE WHEN run_id % 5 <> 0 THEN assessment_id ELSE -1 END AS assessment_id, run_id % 11 <> 0 AND mode = 'SIGNED' AS authenticated, CASE WHEN run_id % 11 = 0 THEN 'MISSING_AUTHENTICATION' ELSE '-' END AS error FROM me"),
    "annotation_violations": (
        annotation_violations,
        "WITH i AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 50 <> 1 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 1000 = 0), c AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 97 <> 5), a AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS image_id, l_partkey AS category_id FROM lineitem), v AS (SELECT 'DUPLICATE_IMAGE_ID' AS violation, id, count(*) AS n FROM i GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'DUPLICATE_CATEGORY_ID', id, count(*) FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'DUPLICATE_ANNOTATION_ID', id, count(*) FROM a GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'ORPHAN_IMAGE', image_id, count(*) FROM a WHERE image_id NOT IN (SELECT id FROM i) GROUP BY image_id UNION ALL SELECT 'ORPHAN_CATEGORY', category_id, count(*) FROM a WHERE category_id NOT IN (SELECT id FROM c) GROUP BY category_id) SELECT violation, count(*) AS subjects, sum(n)::BIGINT AS n FROM v GROUP BY violation",
    ),
    "box_violations": (
        box_violations,
        "WITH b AS (SELECT l_partkey, o_orderkey, l_quantity - 2 AS x, l_discount * 100 AS y, l_quantity / 2 - 1 AS w, l_tax * 400 AS h FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey), p AS (SELECT CASE WHEN l_partkey % 100 = 0 THEN 'BOX_MALFORMED' WHEN w <= 0 OR h <= 0 THEN 'BOX_EMPTY' WHEN x < 0 OR y < 0 OR (o_orderkey IS NOT NULL AND (x + w > 50 OR y + h > 40)) THEN 'BOX_OUTSIDE_IMAGE' END AS problem FROM b) SELECT problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY problem",
    ),
    "label_lines": (
        label_lines,
        "WITH r AS (SELECT l_linenumber + CASE WHEN l_partkey % 50 = 0 THEN 20 ELSE 0 END AS c, l_partkey AS k, round(l_discount * 5, 2) AS x, round(l_tax * 11, 2) AS y, round(l_quantity / 52, 2) AS w FROM lineitem), p AS (SELECT c, CASE WHEN k % 41 = 0 THEN 'TOKEN_COUNT' WHEN k % 77 = 0 THEN 'NOT_NUMERIC' WHEN c >= 8 THEN 'CLASS_OUT_OF_RANGE' WHEN x > 1 OR y > 1 OR w > 1 THEN 'BOX_OUTSIDE_UNIT' ELSE '-' END AS problem FROM r) SELECT problem, count(*) AS n, sum(c)::BIGINT AS classes FROM p GROUP BY problem",
    ),
}
