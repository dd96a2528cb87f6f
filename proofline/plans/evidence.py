"""Catalogue: outputs, tensors and runs one by one; texts of interpretations; validations."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import detect, models, outputs, registry, relational, vectors
from proofline.plans import representation, runs
from proofline.plans.derived import FINDINGS, assurance_findings
from proofline.session import table
from proofline.streaming import windows

_NUMBERS = ("minimum", "maximum", "mean", "rms")


def _outputs(spark, sf_dir):
    """Vectors as outputs; some hold values that are not finite, by rule."""
    spoilt = lambda bad: F.transform("embedding", lambda x, i: F.when(i % 8 == 3, F.lit(bad)).otherwise(x.cast("double")))
    k = F.col("vec_id") % 30
    v = F.when(k == 4, spoilt(float("nan"))).when(k == 5, spoilt(float("inf"))).when(k == 6, spoilt(float("-inf"))).when(k == 7, F.transform("embedding", lambda x: F.lit(0.0)))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.coalesce(v, F.col("embedding").cast("array<double>")).alias("output"))


def output_summaries(spark, sf_dir):
    found = models.output_summary(_outputs(spark, sf_dir))
    return found.select("vec_id", "elements", "n_finite", "n_nan", "n_posinf", "n_neginf", *(F.round(c, 8).alias(c) for c in _NUMBERS))


def output_deltas(spark, sf_dir):
    """Each output against itself with one dimension raised; those with other values have no delta."""
    moved = F.transform("output", lambda x, i: F.when(i == 2, x + 1).otherwise(x))
    found = _outputs(spark, sf_dir).withColumn("d", models.output_delta(F.col("output"), moved))
    zero = F.col("vec_id") % 30 == 7
    return found.select("vec_id", *(F.round(f"d.{c}", 6).alias(c) for c in ("max_abs", "mean_abs", "cosine")), F.when(~zero, F.round("d.normalised_l2", 6)).alias("normalised_l2"))


def repeatability(spark, sf_dir):
    """The events of a user as repeated runs of one sample; their type is the output."""
    status = F.when(F.col("event_id") % 17 == 0, "FAILED").otherwise("OK")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("model_id"), F.col("user_id").alias("sample_id"), F.array("event_type").alias("output"), status.alias("status"))
    return models.repeatability(rows)


def protocol_mismatches(spark, sf_dir):
    """Protocols of the parts before and after edits by rule."""
    p = table(spark, sf_dir, "part")
    edit = lambda c, m: F.when(F.col("p_partkey") % m == 0, "other").otherwise(F.col(c)).alias(c)
    before = p.select(F.col("p_partkey").alias("model_id"), "p_brand", "p_type", "p_name")
    after = p.select(F.col("p_partkey").alias("model_id"), edit("p_brand", 3), edit("p_type", 5), edit("p_name", 7))
    found = models.protocol_mismatches(before, after, ("p_brand", "p_type", "p_name"))
    return found.select("model_id", F.array_join("reasons", ",").alias("reasons"))


def behaviour_change(spark, sf_dir):
    """Flip rates of triggers against the same triggers on vectors turned around."""
    clean, triggered = runs._runs(spark, sf_dir)
    turned = [df.withColumn("output", F.reverse("output")) for df in (clean, triggered)]
    before, after = models.trigger_behaviour(clean, triggered), models.trigger_behaviour(*turned)
    found = models.compare_behaviour(before, after)
    return found.select("model_id", "trigger_id", "pairs", *(F.round(c, 6).alias(c) for c in ("flip_before", "flip_after", "flip_change")))


def tensor_sample(spark, sf_dir):
    """Embeddings as tensors by label; the first that the budget covers are read whole, the others at 100 positions."""
    rows = table(spark, sf_dir, "embeddings").select(F.lit("m").alias("model_id"), F.concat(F.lit("t"), "label").alias("tensor"), "label", "vec_id")
    sizes = rows.groupBy("model_id", "tensor", F.col("label").alias("position")).agg(F.count("*").alias("elements")).withColumn("bytes", F.col("elements") * 8)
    whole = sizes.agg(F.max("bytes").alias("single"), F.sum("bytes").alias("total")).first()
    modes = models.tensor_modes(sizes, (whole["single"] or 1) - 1, (whole["total"] or 0) // 2)
    # positions inside a tensor: ranks of the vectors of one label, spread over the cluster by label
    from pyspark.sql import Window

    values = rows.withColumn("pos", F.row_number().over(Window.partitionBy("tensor").orderBy("vec_id")).cast("long") - 1).select("model_id", "tensor", "pos", F.col("vec_id").alias("value"))
    found = models.sampled_values(values, modes, 20)
    return found.groupBy("tensor", "mode").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("pos").alias("positions"))


def output_rates(spark, sf_dir):
    return outputs.rates(representation._valid(spark, sf_dir), ("role",)).select("role", F.round("abstention_rate", 9).alias("abstention_rate"), "unknown_rate")


def interpretation_texts(spark, sf_dir):
    found = outputs.texts(outputs.interpret(representation._reports(spark, sf_dir), ("key",)))
    return found.select("key", "summary", F.array_join("observations", ";").alias("observations"), F.size("checks").alias("n_checks"))


def layer_problems(spark, sf_dir):
    """Reports of layers that contradict themselves by rule: twice, overlapping, or shifted though unavailable."""
    base = representation._reports(spark, sf_dir)
    shifted = F.when(F.col("key") % 7 == 2, "a,b").otherwise(F.col("shifted"))
    rows = base.withColumn("shifted", shifted).withColumn("stable", F.when(F.col("key") % 5 == 1, "b,c").otherwise("c"))
    twice = rows.where(F.col("key") % 11 == 4)
    return outputs.layer_problems(rows.unionByName(twice), ("key",)).groupBy("layer", "problem").agg(F.count("*").alias("n"))


def unit_vectors(spark, sf_dir):
    found = table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.col("embedding")).alias("u"))
    return found.select("vec_id", F.round(F.get("u", F.lit(0)), 7).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def stable_findings(spark, sf_dir):
    """The first hundred findings by id, a report's feature, and whether there are more."""
    return detect.stable(assurance_findings(spark, sf_dir).select("finding_id", "category"), 100)


def run_problems(spark, sf_dir):
    """Orders as runs, their lines as findings; some hold a line twice or another module's, by rule."""
    module = F.when(F.col("l_partkey") % 90 == 1, "b").otherwise("a")
    line = F.when((F.col("l_linenumber") == 2) & (F.col("l_orderkey") % 12 == 1), 1).otherwise(F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.struct(F.concat(F.lit("F"), line.cast("string")).alias("finding_id"), module.alias("module")).alias("f"))
    gathered = rows.groupBy("run_id").agg(F.collect_list("f").alias("findings")).withColumn("module", F.lit("a"))
    return registry.run_problems(gathered, 6).groupBy(F.coalesce("problem", F.lit("-")).alias("problem")).agg(F.count("*").alias("n"))


def run_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", registry.run_id("o_custkey", "o_orderstatus", "o_orderpriority").alias("run_id"))


def revocations(spark, sf_dir):
    """Orders of a customer as status changes of its key; what is revoked stays so."""
    state = F.element_at(F.array(*map(F.lit, ("ACTIVE", "SUSPENDED", "REVOKED"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key_id"), F.col("o_orderkey").alias("at"), state.alias("state"))
    legal = {None: ("ACTIVE",), "ACTIVE": ("SUSPENDED", "REVOKED"), "SUSPENDED": ("ACTIVE", "REVOKED"), "REVOKED": ()}
    return relational.transitions(log, "key_id", ("at",), "state", legal).groupBy("state", "is_legal").agg(F.count("*").alias("n"))


def session_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = windows.sessions(e, "ts", "2 hours", "1 day", "user_id")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


_OUT = """o AS (SELECT vec_id, label, list_transform(embedding, lambda x, i: CASE WHEN vec_id % 30 = 7 THEN 0.0 WHEN (i - 1) % 8 = 3 AND vec_id % 30 = 4 THEN 'nan'::DOUBLE WHEN (i - 1) % 8 = 3 AND vec_id % 30 = 5 THEN 'inf'::DOUBLE WHEN (i - 1) % 8 = 3 AND vec_id % 30 = 6 THEN '-inf'::DOUBLE ELSE x::DOUBLE END) AS v FROM embeddings),
u AS (SELECT vec_id, unnest(v) AS x FROM o)"""
_SAW = "CASE WHEN {x} THEN 'moved' WHEN {s} IN ('COMPLETE', 'PARTIAL') THEN 'steady' ELSE 'not assessed, ' || coalesce({s}, 'NOT_PROVIDED') END"

QUERIES = {
    "output_summaries": (
        output_summaries,
        f"WITH {_OUT} SELECT vec_id, count(*) AS elements, count(*) FILTER (isfinite(x)) AS n_finite, count(*) FILTER (isnan(x)) AS n_nan, count(*) FILTER (x = 'inf'::DOUBLE) AS n_posinf, count(*) FILTER (x = '-inf'::DOUBLE) AS n_neginf, round(min(x) FILTER (isfinite(x)), 8) AS minimum, round(max(x) FILTER (isfinite(x)), 8) AS maximum, round(avg(x) FILTER (isfinite(x)), 8) AS mean, round(sqrt(avg(x * x) FILTER (isfinite(x))), 8) AS rms FROM u GROUP BY vec_id",
    ),
    "output_deltas": (
        output_deltas,
        f"WITH {_OUT}, w AS (SELECT vec_id, v, list_transform(v, lambda x, i: CASE WHEN i = 3 THEN x + 1 ELSE x END) AS w, vec_id % 30 IN (4, 5, 6) AS bad, vec_id % 30 = 7 AS zero FROM o) SELECT vec_id, CASE WHEN NOT bad THEN 1.0 END::DOUBLE AS max_abs, CASE WHEN NOT bad THEN round(1 / 64, 6) END AS mean_abs, CASE WHEN NOT bad AND NOT zero THEN round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) END AS cosine, CASE WHEN NOT bad AND NOT zero THEN round(1 / sqrt(list_dot_product(v, v)), 6) END AS normalised_l2 FROM w",
    ),
    "repeatability": (repeatability, "SELECT user_id % 7 AS model_id, user_id AS sample_id, count(*) AS repeats, count(DISTINCT event_type) AS outputs FROM events WHERE event_id % 17 <> 0 GROUP BY ALL"),
    "protocol_mismatches": (protocol_mismatches, "SELECT p_partkey AS model_id, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'P_BRAND_MISMATCH' END, CASE WHEN p_partkey % 5 = 0 THEN 'P_TYPE_MISMATCH' END, CASE WHEN p_partkey % 7 = 0 THEN 'P_NAME_MISMATCH' END) AS reasons FROM part"),
    "behaviour_change": (
        behaviour_change,
        f"WITH x AS (WITH {runs._BEH} SELECT * FROM h), y AS (WITH {runs._BEH.replace('list_transform(embedding, lambda x: x::DOUBLE * 10) AS o', 'list_reverse(list_transform(embedding, lambda x: x::DOUBLE * 10)) AS o').replace('WHEN i = 3 THEN', 'WHEN i = 62 THEN')} SELECT * FROM h) SELECT x.model_id, 'p' || x.t AS trigger_id, x.pairs, round(x.flip_rate, 6) AS flip_before, round(y.flip_rate, 6) AS flip_after, round(y.flip_rate - x.flip_rate, 6) AS flip_change FROM x JOIN y ON x.model_id = y.model_id AND x.t = y.t WHERE x.pairs = y.pairs",
    ),
    "tensor_sample": (
        tensor_sample,
        """WITH RECURSIVE s AS (SELECT label, count(*) AS elements, count(*) * 8 AS b FROM embeddings GROUP BY label), o AS (SELECT *, row_number() OVER (ORDER BY label) AS i, (SELECT max(b) - 1 FROM s) AS single FROM s),
        m AS (SELECT 0::BIGINT AS i, (SELECT sum(b) // 2 FROM s)::BIGINT AS budget, NULL::INTEGER AS label, NULL::BIGINT AS elements, NULL::VARCHAR AS mode
          UNION ALL SELECT o.i, (CASE WHEN b <= single AND b <= budget THEN budget - b ELSE budget END)::BIGINT, o.label, o.elements, CASE WHEN b <= single AND b <= budget THEN 'FULL' ELSE 'SAMPLED' END FROM m JOIN o ON o.i = m.i + 1),
        p AS (SELECT DISTINCT label, mode, CASE WHEN mode = 'FULL' OR elements <= 20 THEN k ELSE k * (elements - 1) // 19 END AS pos FROM m, range(0, CASE WHEN mode = 'FULL' OR elements <= 20 THEN elements ELSE 20 END) r(k) WHERE i > 0)
        SELECT 't' || label AS tensor, mode, count(*) AS n, min(pos) AS first, max(pos) AS last, sum(pos)::BIGINT AS positions FROM p GROUP BY ALL""",
    ),
    "output_rates": (output_rates, f"WITH {representation._PRED} SELECT role, round(avg(ab::INT), 9) AS abstention_rate, NULL::DOUBLE AS unknown_rate FROM g GROUP BY role"),
    "interpretation_texts": (
        interpretation_texts,
        f"""WITH {representation._LAYER}, y AS (SELECT key, {", ".join(f"max(status) FILTER (i = {i}) AS s{i}, coalesce(bool_or(hit) FILTER (i = {i}), false) AS x{i}" for i in range(3))} FROM r GROUP BY key)
        SELECT key, CASE WHEN NOT usable THEN 'No layer could be assessed.' WHEN changed = 0 THEN 'None of the assessed layers moved.' || g ELSE 'Moved: ' || replace(changed_layers, ',', ', ') || '.' || g END AS summary,
        'IMAGE: ' || {_SAW.format(x="x0", s="s0")} || ';REPRESENTATION: ' || {_SAW.format(x="x1", s="s1")} || ';OUTPUT: ' || {_SAW.format(x="x2", s="s2")} AS observations, (1 + 2 * changed + CASE WHEN complete THEN 0 ELSE 1 END)::INTEGER AS n_checks
        FROM (SELECT *, CASE WHEN complete THEN '' ELSE ' Not every layer was fully assessed.' END AS g FROM a) JOIN y USING (key)""",
    ),
    "layer_problems": (
        layer_problems,
        f"WITH {representation._LAYER}, k AS (SELECT layer, key, status, hit OR key % 7 = 2 AS hit, key % 5 = 1 AS b, CASE WHEN key % 11 = 4 THEN 2 ELSE 1 END AS n FROM r) SELECT layer, 'DUPLICATE_LAYER' AS problem, count(*) AS n FROM k WHERE n = 2 GROUP BY layer UNION ALL SELECT layer, 'OVERLAPPING_PARTITIONS', sum(n)::BIGINT FROM k WHERE hit AND b GROUP BY layer UNION ALL SELECT layer, 'IMPOSSIBLE_COVERAGE', sum(n)::BIGINT FROM k WHERE hit AND status = 'UNAVAILABLE' GROUP BY layer",
    ),
    "unit_vectors": (unit_vectors, "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 7) AS first, round(list_sum(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS total FROM embeddings"),
    "stable_findings": (stable_findings, f"WITH {FINDINGS} SELECT finding_id, category, (SELECT count(*) FROM f) > 100 AS partial FROM f ORDER BY finding_id LIMIT 100"),
    "run_problems": (
        run_problems,
        "WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT CASE WHEN l_linenumber = 2 AND l_orderkey % 12 = 1 THEN 1 ELSE l_linenumber END) AS d, bool_or(l_partkey % 90 = 1) AS b FROM lineitem GROUP BY l_orderkey) SELECT CASE WHEN n > 6 THEN 'TOO_MANY_FINDINGS' WHEN d < n THEN 'DUPLICATE_FINDING_IDS' WHEN b THEN 'MODULE_MISMATCH' ELSE '-' END AS problem, count(*) AS n FROM g GROUP BY 1",
    ),
    "run_ids": (run_ids, "SELECT o_orderkey, 'R-' || substr(sha256(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority), 1, 24) AS run_id FROM orders"),
    "revocations": (
        revocations,
        "WITH l AS (SELECT o_custkey AS k, ['ACTIVE', 'SUSPENDED', 'REVOKED'][o_orderkey % 3 + 1] AS state, lag(['ACTIVE', 'SUSPENDED', 'REVOKED'][o_orderkey % 3 + 1]) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) SELECT state, CASE WHEN p IS NULL THEN state = 'ACTIVE' WHEN p = 'ACTIVE' THEN state <> 'ACTIVE' WHEN p = 'SUSPENDED' THEN state <> 'SUSPENDED' ELSE false END AS is_legal, count(*) AS n FROM l GROUP BY ALL",
    ),
    "session_counts": (
        session_counts,
        "WITH l AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 HOUR, true) AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest FROM n GROUP BY user_id",
    ),
}
