"""Hand-sized inputs with known results, and edge cases."""

import collections
import decimal
import hashlib
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from proofline.functions import columns as C
from proofline.functions import policies
from proofline.functions.policies import ComparisonPolicy
from proofline.operators import audit, compare, dataset_scan, detect, models, outputs, profile, quantiles, registry, relational, scoring, vectors
from proofline import session
from proofline.plans import reports, runs


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def hash_tree(identities):
    """The commitment of identities, node by node."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = {h: f"{h}*{n}" for h, n in collections.Counter(map(sha, identities)).items()}
    for digits in (6, 3, 0):
        nodes = {}
        for h in sorted(level):
            nodes.setdefault(h[:digits], []).append(level[h])
        level = {p: sha(",".join(children)) for p, children in nodes.items()}
    return level[""]


def test_columns(spark):
    row = one(spark.range(1).select(C.public(F.lit(-1e-15)).alias("zero"), C.bounded_text(F.lit("x" * 600)).alias("cut"), C.basename(F.lit("a\\b/c.onnx")).alias("base"), C.evidence_value(F.array(F.lit("a=1"), F.lit("b=2=3")), "b").alias("value"), C.product(F.array(F.lit(3), F.lit(4))).alias("p"), C.product(F.array(F.lit(1 << 62), F.lit(4))).alias("over"), C.strict_base64(F.lit("aGk="), 10).alias("raw"), C.strict_base64(F.lit("a%"), 10).alias("bad"), C.masked(F.lit("a\x01b")).alias("m")))
    assert str(row.zero) == "0.0" and len(row.cut) == 512 and row.cut.endswith("...[truncated]") and row.base == "c.onnx" and row.value == "2=3"
    assert row.p == 12 and row.over is None and bytes(row.raw) == b"hi" and row.bad is None and row.m == "a?b"
    paths = spark.createDataFrame([("/x",), ("C:\\x",), ("a/../b",), ("a/b..c",)], "p string")
    assert [r.u for r in paths.select(C.unsafe_path(F.col("p")).alias("u")).collect()] == [True, True, True, False]


def test_entropy_and_margin(spark):
    rows = spark.createDataFrame([([0.5, 0.5],), ([1.0, 0.0],), ([0.9, 0.1],), ([1.0],)], "p array<double>")
    got = rows.select(F.round(C.entropy(F.col("p")), 6).alias("e"), F.round(C.margin(F.col("p")), 6).alias("m")).collect()
    assert [(r.e, r.m) for r in got] == [(1.0, 0.0), (0.0, 1.0), (0.468996, 0.8), (0.0, None)]


def test_near_pairs_are_all_pairs(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    sigs = base + [s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 13))) for s in base]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(s)) for i, s in enumerate(sigs)] + [(999, None)], "k long, s long")
    got = sorted((r.a, r.b, r.distance) for r in detect.near_pairs(df, "k", "s", 10).collect())
    assert got == sorted((i, j, bin(sigs[i] ^ sigs[j]).count("1")) for i in range(120) for j in range(i + 1, 120) if bin(sigs[i] ^ sigs[j]).count("1") <= 10)
    conf = detect.near_findings(spark.createDataFrame([(1, 2, 0), (1, 3, 10), (1, 4, 64)], "a long, b long, distance int")).select("confidence", "severity").collect()
    assert [(r.confidence, r.severity) for r in conf] == [(1.0, "HIGH"), (0.84, "MEDIUM"), (0.0, "LOW")]


def test_duplicates_and_outliers(spark):
    files = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y"), ("d", None)], "path string, content string")
    group = one(detect.duplicate_groups(files, "path", "content"))
    assert (group.n, group.asset_id, group.paths) == (2, "a", ["a", "b"])
    scores = spark.createDataFrame([(str(i), s) for i, s in enumerate((0.10, 0.11, 0.12, 0.13, 0.40))], "path string, score double")
    found = detect.outliers(scores, detect.outlier_threshold(scores))
    assert [r.score for r in found.collect()] == [0.40]
    assert one(detect.outlier_threshold(scores.limit(3))).method == "insufficient"
    assert one(detect.outlier_threshold(scores.limit(0))).method == "empty"
    vectors_ = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="zero vector"):
        detect.outlier_scores(vectors_, "id", "v").collect()


def test_dataset_risk(spark):
    rows = [("HIGH", "A", "x", 1.0, ["e"]), ("HIGH", "A", "x", 0.5, ["e"])]
    df = spark.createDataFrame(rows, "severity string, category string, asset_id string, confidence double, evidence array<string>")
    assert (one(detect.dataset_risk(df)).risk_score, one(detect.dataset_risk(df)).risk_band) == (60.0, "HIGH")
    with pytest.raises(Exception, match="unknown severity"):
        detect.dataset_risk(df.withColumn("severity", F.lit("INFO"))).collect()


def test_profiles_and_divergences(spark):
    values = spark.createDataFrame([("f", v) for v in (0.0, 0.5, 1.0, 1.0, -0.1, 1.1)], "feature string, value double")
    assert one(profile.dense(profile.histogram(values, ("feature",), 2), ("feature",), 2)).counts == [1, 3]
    counts = spark.createDataFrame([("f", "REFERENCE", 0, 5), ("f", "CURRENT", 1, 9)], "feature string, role string, bin int, n long")
    row = one(compare.divergences(counts, ("feature",), "bin", 2))
    assert (row.js, row.tv, row.wasserstein) == (1.0, 1.0, 0.5)
    assert one(compare.divergences(counts.where("bin = 0"), ("feature",), "bin", 2)).js is None
    names = spark.createDataFrame([(x,) for x in "aabbccdde"], "v string")
    got = {r.value: r.n for r in profile.category_counts(names, (), "v", 3).collect()}
    assert got == {"a": 2, "b": 2, "OTHER": 5}
    shuffled = profile.commitment(names.orderBy(F.rand()), (), F.col("v")).collect() + profile.commitment(names, (), F.col("v")).collect()
    assert shuffled[0] == shuffled[1] and shuffled[0].samples == 9 and shuffled[0].commitment == hash_tree("aabbccdde")
    assert one(profile.commitment(names.where("v != 'a'"), (), F.col("v"))).commitment != shuffled[0].commitment
    assert profile.commitment(names.limit(0), ("v",), F.col("v")).count() == 0


def test_continuous_shift(spark):
    rows = [("f", r, float(v)) for r, base in (("REFERENCE", 0), ("CURRENT", 30)) for v in range(base, base + 25)]
    values = spark.createDataFrame(rows, "feature string, role string, value double")
    state = lambda df, **k: one(compare.continuous(profile.numeric_profile(df, ("feature", "role")), ("feature",), **k)).state
    assert state(values) == "SHIFTED" and state(values.where("value < 55 AND role = 'REFERENCE'")) == "UNAVAILABLE"
    assert state(values, policy=ComparisonPolicy(support=26)) == "INSUFFICIENT"
    assert state(values.withColumn("value", F.when(F.col("role") == "CURRENT", 2.0).otherwise(1.0))) == "SHIFTED"
    assert state(values.withColumn("value", F.lit(1.0))) == "STABLE"
    with pytest.raises(ValueError):
        ComparisonPolicy(support=0)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0])], "id long, v array<double>")
    row = one(vectors.moments(df, (), "v"))
    assert (row.centroid, row.variance) == ([1.0, 0.0], [1.0, 0.0])
    ranks = spark.createDataFrame([("a", i) for i in range(100)], "role string, i long")
    got = sorted(r.i for r in vectors.spaced(ranks, ("role",), "i", 7).collect())
    assert got == [int(k * 99 / 6) for k in range(7)]
    assert vectors.spaced(ranks, ("role",), "i", 500).count() == 100 and vectors.hashed_subset(ranks, "i", 9).count() == 9


def test_interpretation_patterns(spark):
    rows, want = [], {}
    for k in range(8):
        hits = [x for i, x in enumerate(outputs.LAYERS) if k >> i & 1]
        rows += [(k, x, "COMPLETE", "f" if x in hits else "") for x in outputs.LAYERS]
        want[k] = {0: "NO_SHIFT_OBSERVED", 1: f"{(hits or [''])[0]}_SHIFT_ONLY", 2: "_AND_".join(hits) + "_SHIFT", 3: "BROAD_MULTILAYER_SHIFT"}[len(hits)]
    rows += [(10, "IMAGE", "UNAVAILABLE", ""), (11, "IMAGE", "PARTIAL", "f"), (12, "IMAGE", "COMPLETE", "")]
    want |= {10: "DISTRIBUTION_SHIFT_EVIDENCE_UNAVAILABLE", 11: "DISTRIBUTION_SHIFT_WITH_INCOMPLETE_COVERAGE", 12: "DISTRIBUTION_SHIFT_EVIDENCE_INCOMPLETE"}
    df = spark.createDataFrame(rows, "k int, layer string, status string, shifted string")
    read = outputs.interpret(df, ("k",))
    assert {r.k: r.pattern for r in read.collect()} == want
    found = {r.k: (r.severity, r.confidence) for r in outputs.shift_findings(read).collect()}
    assert 0 not in found and found[1] == ("MEDIUM", 0.9) and found[3] == ("HIGH", 0.9) and found[7] == ("HIGH", 0.9) and found[10] == ("MEDIUM", 1.0) and found[12] == ("LOW", 1.0)
    odd = spark.createDataFrame([(1, "IMAGE", "COMPLETE", "a", "a"), (1, "IMAGE", "UNAVAILABLE", "b", "")], "k int, layer string, status string, shifted string, stable string")
    assert {r.problem for r in outputs.layer_problems(odd, ("k",)).collect()} == {"DUPLICATE_LAYER", "OVERLAPPING_PARTITIONS", "IMPOSSIBLE_COVERAGE"}


def test_tensor_statistics(spark):
    value = lambda xs, t="t": [("m", t, float(x)) for x in xs]
    schema = "model_id string, tensor string, value double"
    row = one(models.tensor_stats(spark.createDataFrame(value([0, 1, 2, 3]), schema)))
    assert (row.mean, round(row.rms, 9), row.l1, round(row.l2, 9), row["median"], row.mad, row.zero_fraction) == (1.5, round(3.5**0.5, 9), 6.0, round(14**0.5, 9), 1.5, 1.0, 0.25)
    row = one(models.tensor_stats(spark.createDataFrame(value(["nan", "inf", "-inf", 1]), schema)))
    assert (row.n_finite, row.n_nan, row.n_posinf, row.n_neginf, row.maximum) == (1, 1, 1, 1, 1.0)
    row = one(models.tensor_stats(spark.createDataFrame(value([1e300, 1e300]), schema)))
    assert abs(row.rms / 1e300 - 1) < 1e-9
    rows = value([0] * 4, "zero") + value([1] * 4, "flat") + value([1e-10, 1], "near")
    stats = models.tensor_stats(spark.createDataFrame(rows, schema))
    assert {r.tensor: r.near_zero_fraction for r in stats.collect()}["near"] == 0.5
    assert {(r.tensor, r.code) for r in models.value_issues(stats).collect()} == {("zero", "ALL_ZERO_TENSOR"), ("flat", "CONSTANT_TENSOR")}
    text = one(spark.range(1).select(models.redacted(F.array(F.lit("api_key=abc"), F.lit("n=1\n2"), F.lit("file_path=/x"), F.lit("n=1\n2"))).alias("e")))
    assert text.e == ["api_key=[redacted]", "file_path=[redacted]", "n=1 2"]


def test_perturbation(spark):
    samples = spark.createDataFrame([(1, [1.0] * 16)], "sample_id long, pixels array<double>")
    triggers = spark.createDataFrame([("s", "solid", 0, 0, 2, 2, 9.0), ("z", "zero", 2, 2, 2, 2, 9.0), ("c", "checkerboard", 1, 1, 2, 2, 9.0)], "trigger_id string, kind string, top int, left int, ph int, pw int, value double")
    got = {r.trigger_id: r.pixels for r in models.perturbed(samples, triggers, 4, 4).collect()}
    assert got["s"][:6] == [9, 9, 1, 1, 9, 9] and got["z"][10:12] == [0, 0] and [got["c"][i] for i in (5, 6, 9, 10)] == [0, 9, 9, 0]


def test_scores(spark):
    rows = [("f1", "dataset_integrity", "sample", "NEAR_DUPLICATE", "HIGH", "0.91", "REVIEW"), ("f2", "model_integrity", "model", "BACKDOOR_BEHAVIOR", "CRITICAL", "0.89", "QUARANTINE"), ("f3", "inference_integrity", "pipeline", "REPLAY_DETECTED", "CRITICAL", "1.0", "REJECT"), ("f4", "distribution_shift", "dataset", "OUTPUT_SHIFT_ONLY", "MEDIUM", "0.82", "REVIEW")]
    df = spark.createDataFrame(rows, "finding_id string, module string, asset_type string, category string, severity string, confidence string, recommendation string").withColumn("confidence", F.col("confidence").cast("decimal(10,6)"))
    got = {r.module: r.s for r in scoring.module_scores(df).select("module", F.round("score", 1).alias("s")).collect()}
    assert got == {"dataset_integrity": Decimal("59.1"), "model_integrity": Decimal("33.3"), "inference_integrity": Decimal("25.0"), "distribution_shift": Decimal("83.6")}
    row = one(scoring.overall(df))
    assert (row.score, row.disposition, row.assessment, row.most_concerning) == (Decimal("45.2"), "QUARANTINE", "COMPLETE", "inference_integrity")
    broken = spark.createDataFrame([("COMPROMISED",)], "audit_status string")
    assert one(scoring.overall(df, broken)).reason == "AUDIT_COMPROMISED"
    nothing = one(scoring.overall(df.limit(0)))
    assert (nothing.score, nothing.assessment, nothing.status) == (None, "UNAVAILABLE", "UNKNOWN")


def test_audit_breaks(spark):
    rows = [("c", "E", "a", str(i), f'{{"k":{i}}}', f"2024-01-01 00:00:{i:02d}") for i in range(5)]
    events = spark.createDataFrame(rows, "chain string, event_type string, asset_type string, asset_id string, payload_json string, t string").withColumn("ts", F.to_timestamp("t"))
    log = audit.build(events, "chain", ("ts",))
    code = lambda df: (lambda r: (r.status, r.first_broken, r.code))(one(audit.verify(df)))
    third = F.col("sequence") == 3
    assert code(log) == ("VALID", None, None)
    assert code(log.withColumn("payload_json", F.when(third, '{"k":9}').otherwise(F.col("payload_json")))) == ("COMPROMISED", "AUD-00000003", "AUDIT_RECORD_TAMPERING")
    assert code(log.where(~third)) == ("COMPROMISED", "AUD-00000004", "AUDIT_CHAIN_LINK_FAILURE")
    assert code(log.withColumn("sequence", F.when(F.col("sequence") == 5, 6).otherwise(F.col("sequence")))) == ("COMPROMISED", "AUD-00000005", "AUDIT_SEQUENCE_VIOLATION")
    assert code(log.withColumn("payload_json", F.when(third, "{").otherwise(F.col("payload_json")))) == ("COMPROMISED", "AUD-00000003", "AUDIT_RECORD_MALFORMED")


def test_ingest_and_lifecycle(spark):
    stored = spark.createDataFrame([("f1", "a")], "finding_id string, content string")
    runs = spark.createDataFrame([("r1", "f1", "a"), ("r1", "f2", "b"), ("r2", "f1", "changed"), ("r2", "f3", "c")], "run_id string, finding_id string, content string")
    assert {r.run_id: (r.accepted, r.created, r.existing, r.conflicts) for r in registry.ingest_runs(runs, stored).collect()} == {"r1": (True, 1, 1, 0), "r2": (False, 1, 0, 1)}
    log = spark.createDataFrame([(1, 1, "DRAFT"), (1, 2, "ACTIVE"), (1, 3, "SEALED"), (1, 4, "ACTIVE"), (2, 1, "ACTIVE")], "assessment_id long, at long, state string")
    assert [r.is_legal for r in registry.lifecycle(log).orderBy("assessment_id", "at").collect()] == [True, True, True, False, False]
    assert {r.assessment_id: r.state for r in relational.current_state(log, "assessment_id", ("at",)).collect()} == {1: "ACTIVE", 2: "ACTIVE"}
    keys = spark.createDataFrame([("k1", "p1", "x"), ("k1", "p2", "x"), ("k2", "p1", "y")], "key_id string, producer_id string, fingerprint string")
    assert {r.conflict for r in registry.key_conflicts(keys).collect()} == {"KEY_CONTENT_CONFLICT", "FINGERPRINT_BOUND_TWICE"}
    twin = spark.createDataFrame([(None, "a"), ("x", None)], "k string, v string")
    assert relational.named_diff(twin, twin, ("k",), ("v",)).count() == 0


def test_dataset_scan_counts_every_finding(spark, tmp_path):
    n = 12_000
    rows = spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id) AS lang", "'s' AS source")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(50).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> float(sin(i * (id + 1)))) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    rare = [r for r in reports.dataset_scan_findings(spark, str(tmp_path)).collect() if "RARE" in r.category or "LABEL" in r.category]
    # the query gives the documents 7, 4008 and 8009 one label
    assert sum(r.n for r in rare) == sum(r.assets for r in rare) == n - 3
    samples = rows.selectExpr("string(doc_id) AS sample_id", "text AS content", "source AS contributor_id", "lang AS batch_id")
    labels = rows.selectExpr("string(doc_id) AS sample_id", "lang AS label")
    found, summary = dataset_scan.analyze(samples, labels)
    assert found.where("NOT partial").count() == one(summary).unique_findings == n
    first, _ = dataset_scan.analyze(samples, labels, most=7)
    assert first.where("partial").count() == first.count() == 7


def test_tensor_commitments_against_hashlib(spark):
    """The query's hashes again, from values formatted by decimal arithmetic."""
    sf = "/root/testdata/sf0.001"

    def shown(x):
        if x == 0:
            return f"{x:.12e}"
        with decimal.localcontext(decimal.Context(prec=13, rounding=decimal.ROUND_HALF_UP)):
            return f"{+decimal.Decimal(repr(x)):.12e}".replace("e-", "e-0" if abs(x) >= 1e-9 else "e-").replace("e+", "e+0")

    tensors = {}
    for r in sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r.vec_id):
        scale = {5: 0.0, 7: 60.0}.get(r.vec_id % 97, 1.0)
        row = ",".join(shown(x * scale) for x in r.embedding)
        tensors.setdefault(f"t{r.label}", []).append(f"{r.vec_id}:{hashlib.sha256(row.encode()).hexdigest()}")
    values = {t: hash_tree(rows) for t, rows in tensors.items()}
    model = hash_tree([f"{t}:{h}" for t, h in values.items()])
    got = {(r.tensor, r.value_sha256, r.model_fingerprint) for r in runs.tensor_commitments(spark, sf).collect()}
    assert got == {(t, h, model) for t, h in values.items()}


def test_near_classes_lose_no_link(spark):
    """Equal signatures are one class; every pair within the radius is a class pair or shares a class."""
    rng = random.Random(12)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = [(i, rng.choice(base) ^ (1 << rng.randrange(60) if rng.random() < 0.5 else 0)) for i in range(200)] + [(900, None)]
    classes = detect.near_classes(spark.createDataFrame(rows, "k long, s long"), "k", "s")
    of = {r.key: r.representative for r in classes.collect()}
    links = {(r.a, r.b): r.distance for r in detect.near_class_pairs(classes, 4).collect()}
    bits = dict(rows)
    for a in range(200):
        for b in range(a):
            d = (bits[a] ^ bits[b]).bit_count()
            pair = tuple(sorted((of[a], of[b])))
            assert (d == 0) == (of[a] == of[b]) and (links.get(pair) == d if 0 < d <= 4 else pair not in links or d == 0)


def test_shared_folder_is_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = Context

    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        with pytest.raises(RuntimeError):
            session.shared_dir(Session)


@pytest.mark.parametrize("n", [1, 2, 30, 19_999, 60_000])
def test_quantiles_equal_percentile(spark, n):
    x = F.when(F.col("id") % 5 == 0, 1.0).when(F.col("id") % 11 == 0, F.pow(F.lit(2.0), F.col("id") % 900)).otherwise(F.sin(F.col("id")))
    df = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 != 6, x).alias("v"))
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    for keys in (("k",), ()):
        got = {tuple(r[k] for k in keys): [r[q] for q in qs] for r in quantiles.with_quantiles(df, keys, F.col("v"), qs, F.count("*").alias("n"), plain=0).collect()}
        want = {tuple(r[k] for k in keys): r["q"] for r in df.groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, qs.values()))).alias("q")).collect()}
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(list(want[k]), rel=1e-12) for k in want)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert quantiles.with_quantiles(none, ("k",), F.col("v"), {"m": 0.5}).count() == 0
    assert one(quantiles.with_quantiles(none, (), F.col("v"), {"m": 0.5}, F.count("v").alias("n"))).asDict() == {"n": 0, "m": None}
    empty = spark.createDataFrame([("a", None), (None, 2.0)], "k string, v double")
    assert {(r.k, r.m) for r in quantiles.with_quantiles(empty, ("k",), F.col("v"), {"m": 0.5}).collect()} == {("a", None), (None, 2.0)}


def test_output_summary_and_delta(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([(0, [3.0, -4.0, nan, inf, -inf, None]), (1, [1e200, 1e200]), (2, []), (3, None), (4, [0.0, 0.0])], "id int, output array<double>")
    got = {r.id: r for r in models.output_summary(rows).collect()}
    assert (got[0].elements, got[0].n_finite, got[0].n_nan, got[0].n_posinf, got[0].n_neginf) == (6, 2, 1, 1, 1)
    assert got[0].mean == pytest.approx(-0.5) and got[0].rms == pytest.approx(12.5**0.5)
    assert got[1].rms == pytest.approx(1e200) and (got[4].mean, got[4].rms) == (0.0, 0.0)
    assert got[2].elements == got[3].elements == 0 and got[2].mean is None and got[3].minimum is None
    assert len({r.fingerprint for r in got.values()}) == 4
    pairs = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 2.0]), ([nan], [1.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    d = [r.d for r in pairs.select(models.output_delta(F.col("a"), F.col("b")).alias("d")).collect()]
    assert d[0].max_abs == 1.0 and d[0].normalised_l2 == pytest.approx(2**0.5) and d[0].cosine == 0.0
    assert d[1].max_abs is None and d[2].mean_abs is None and d[3].cosine is None and d[3].normalised_l2 == pytest.approx(1e12)


def test_sampled_tensors(spark):
    tensors = spark.createDataFrame([("m", "a", 0, 10, 80), ("m", "b", 1, 7, 100), ("m", "c", 2, 3, 24), ("n", "a", 0, 1, 8)], "model_id string, tensor string, position int, elements long, bytes long")
    modes = models.tensor_modes(tensors, 90, 100)
    assert {(r.model_id, r.tensor): r["mode"] for r in modes.collect()} == {("m", "a"): "FULL", ("m", "b"): "SAMPLED", ("m", "c"): "SAMPLED", ("n", "a"): "FULL"}
    values = tensors.select("model_id", "tensor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("elements") - 1)).alias("pos"))
    for most in (1, 2, 4, 7):
        taken = models.sampled_values(values, modes, most).where("tensor = 'b'").collect()
        assert sorted(r.pos for r in taken) == ([0] if most == 1 else [i * 6 // (most - 1) for i in range(most)])


def test_running_sums_span_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None, "b"]) if i % 3 else "a", rng.randrange(1 << 30), rng.randrange(-5, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at long, x long").repartition(7)
    got = {(r.k, r.at): (r.running, r.total) for r in relational.running_sum(df, ("k",), ("at",), F.col("x")).collect()}
    want = {}
    for k in ("a", "b", None):
        mine = sorted(r[1:] for r in rows if r[0] == k)
        for i, (at, _) in enumerate(mine):
            want[k, at] = (sum(x for _, x in mine[: i + 1]), sum(x for _, x in mine))
    assert got == want
    assert relational.running_sum(df.limit(0), ("k",), ("at",), F.lit(1)).count() == 0
    ranks = [r.running for r in relational.running_sum(df.select("at"), (), ("at",), F.lit(1)).orderBy("at").collect()]
    assert ranks == list(range(1, 3001))


def test_policies_have_ids_and_limits():
    assert policies.WindowLimits().policy_id == policies.WindowLimits().policy_id != policies.WindowLimits(bins=64).policy_id
    for wrong in (lambda: policies.WindowLimits(bins=5000), lambda: policies.WindowLimits(samples=0), lambda: policies.WindowLimits(pixels=1.5), lambda: ComparisonPolicy(js=1.5), lambda: ComparisonPolicy(smd=float("inf"))):
        with pytest.raises(ValueError):
            wrong()
    assert ComparisonPolicy().policy_id.startswith("comparison-policy:sha256:") and policies.PredictionPolicy().policy_id != ComparisonPolicy().policy_id
    space = policies.VectorSpace("e", "1", 64)
    assert space.space_id == policies.VectorSpace("e", "1", 64).space_id != policies.VectorSpace("e", "1", 64, digest="sha256:" + "a" * 64).space_id
    out = policies.OutputSpace(("a", "b"))
    assert out.space_id != policies.OutputSpace(("b", "a")).space_id
    for wrong in (lambda: policies.VectorSpace("", "1", 4), lambda: policies.VectorSpace("e", "1", 0), lambda: policies.VectorSpace("e", "1", 4, digest="x"), lambda: policies.OutputSpace(("a", "a")), lambda: policies.OutputSpace(()), lambda: policies.OutputSpace(("a",), head="")):
        with pytest.raises(ValueError):
            wrong()


def test_fixed_outliers_and_layouts(spark):
    scores = spark.createDataFrame([("a", 0.2), ("b", 0.9)], "path string, score double")
    row = one(detect.outlier_threshold(scores, policy=policies.OutlierPolicy(fixed=0.5)))
    assert (row.method, row.threshold) == ("fixed", 0.5)
    assert [r.path for r in detect.outliers(scores, detect.outlier_threshold(scores, policy=policies.OutlierPolicy(fixed=0.5))).collect()] == ["b"]
    places = models.default_triggers(64, 300)
    assert len(places) == 15 and {(t[5], t[6]) for t in places} == {(8, 32)} and len(models.default_triggers(8, 8, 0.5, 1.0)) == 10
    assert {t[2]: t[3:5] for t in places} == {"top_left": (0, 0), "top_right": (0, 268), "bottom_left": (56, 0), "bottom_right": (56, 268), "center": (28, 134)}
    with pytest.raises(ValueError):
        models.perturbed(scores, scores, 1, 1, 1, "CHW")


def test_near_pairs_of_any_number_of_blocks(spark):
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(40)]
    sigs = base + [s ^ sum(1 << b for b in rng.sample(range(64), rng.choice((0, 9, 10, 11)))) for s in base] + base[:3]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(s)) for i, s in enumerate(sigs)], "k long, s long")
    want = sorted((i, j, bin(sigs[i] ^ sigs[j]).count("1")) for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if bin(sigs[i] ^ sigs[j]).count("1") <= 10)
    for blocks in (11, 12, 14):
        assert sorted(map(tuple, detect.near_pairs(df, "k", "s", 10, blocks).collect())) == want


def test_candidates_stay_level_as_signatures_grow(spark):
    assert [detect.block_count(n) for n in (10, 100_000, 400_000, 1_600_000)] == [11, 11, 12, 13]
    each = []
    for n in (2_000, 8_000):
        df = spark.range(n).select(F.col("id").alias("k"), F.xxhash64("id").alias("s"))
        blocks = 11 if n == 2_000 else 12  # what four times the signatures get where the first number is just enough
        each.append(detect.near_candidates(df, "k", "s", 10, blocks).count() / n)
    assert 0.5 < each[1] / each[0] < 1.5, each


def test_one_long_chain_is_verified_by_all_tasks(spark):
    """A chain of many records, with a break in the middle and one near the end: the first is found."""
    n = 20_000
    rows = [("c", i, f"AUD-{i:08d}", "E", "t", "a", "{}", "2024-01-01T00:00:00.000000Z") for i in range(1, n + 1)]
    before, done = "0" * 64, []
    for chain, sequence, audit_id, event, kind, asset, payload, at in rows:
        record = {"asset_id": asset, "asset_type": kind, "audit_id": audit_id, "event_type": event, "payload_json": payload, "previous_hash": before, "sequence": sequence, "timestamp": at}
        own = hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        done.append((chain, sequence, audit_id, event, kind, asset, payload, at, before, own))
        before = own
    schema = "chain string, sequence long, audit_id string, event_type string, asset_type string, asset_id string, payload_json string, timestamp string, previous_hash string, current_hash string"
    assert audit.GENESIS == "0" * 64
    assert one(audit.verify(spark.createDataFrame(done, schema).repartition(5))).asDict() == {"chain": "c", "records": n, "status": "VALID", "first_broken": None, "code": None}
    done[n // 2] = (*done[n // 2][:6], '{"x":1}', *done[n // 2][7:])
    del done[-2]
    got = one(audit.verify(spark.createDataFrame(done, schema).repartition(5)))
    assert (got.records, got.status, got.first_broken, got.code) == (n - 1, "COMPROMISED", f"AUD-{n // 2 + 1:08d}", "AUDIT_RECORD_TAMPERING")


def test_external_locations(spark):
    cases = {
        "": "EXTERNAL_DATA_LOCATION_MISSING", None: None, "w.bin": "EXTERNAL_DATA_NOT_VERIFIED", "a/./b.bin": "EXTERNAL_DATA_NOT_VERIFIED", "100%.bin": "EXTERNAL_DATA_NOT_VERIFIED", "a+b": "EXTERNAL_DATA_NOT_VERIFIED", "a..b/c": "EXTERNAL_DATA_NOT_VERIFIED",
        "/abs": "EXTERNAL_DATA_PATH_UNSAFE", "../up": "EXTERNAL_DATA_PATH_UNSAFE", "a/../b": "EXTERNAL_DATA_PATH_UNSAFE", "a\\..\\b": "EXTERNAL_DATA_PATH_UNSAFE", "%2e%2e/x": "EXTERNAL_DATA_PATH_UNSAFE", "%2Fabs": "EXTERNAL_DATA_PATH_UNSAFE", "http://h/x": "EXTERNAL_DATA_PATH_UNSAFE", "c:/x": "EXTERNAL_DATA_PATH_UNSAFE", "a%00b": "EXTERNAL_DATA_PATH_UNSAFE",
    }
    df = spark.createDataFrame([(c,) for c in cases], "location string")
    assert {r.location: r.code for r in df.withColumn("code", models.external_location(F.col("location"))).collect()} == cases


def test_structure_of_an_empty_model(spark):
    none = [spark.createDataFrame([], s) for s in ("model_id string, direction string, name string, shape array<string>", "model_id string, index long, name string, op_type string, domain string", "model_id string, name string, location string, dims array<long>")]
    got = models.structure_report(spark.createDataFrame([("m",)], "model_id string"), *none).collect()
    assert {(r.code, r.severity, tuple(r.evidence)) for r in got} == {(c, "HIGH", ()) for c in ("NO_GRAPH_INPUTS", "NO_GRAPH_OUTPUTS", "EMPTY_GRAPH")}
    totals = models.parameter_totals(spark.createDataFrame([("m", []), ("m", [2**40, 2**40]), ("n", [0, 5])], "model_id string, dims array<long>"))
    assert {(r.model_id, r.n_initializers, int(r.n_parameters)) for r in totals.collect()} == {("m", 2, 2**80 + 1), ("n", 1, 0)}


def test_behaviour_reports_without_common_support(spark):
    rates = "model_id string, trigger_id string, pairs long, flip_rate double, lift double, control_relative double"
    before = spark.createDataFrame([("a", "t", 4, 0.5, 0.1, None), ("a", "u", 4, 0.5, 0.1, 0.2), ("a", "gone", 4, 1.0, 1.0, 1.0), ("b", "t", 0, 0.0, 0.0, 0.0)], rates)
    after = spark.createDataFrame([("a", "t", 5, 0.9, 0.9, 0.9), ("a", "u", 4, 0.75, float("nan"), 0.2), ("b", "t", 0, 1.0, 1.0, 1.0)], rates)
    deltas = models.behaviour_deltas(before, after)
    assert {(r.model_id, r.trigger_id): tuple(r)[2:] for r in deltas.collect()} == {("a", "t"): (None,) * 3, ("a", "u"): (0.25, None, 0.0), ("b", "t"): (None,) * 3}
    issue = lambda *rows: spark.createDataFrame(list(rows), "model_id string, trigger_id string, code string")
    reports = spark.createDataFrame([("a", "COMPLETE", "COMPLETE"), ("b", "COMPLETE", "COMPLETE"), ("c", None, "COMPLETE")], "model_id string, status_before string, status_after string")
    got = {r.model_id: r for r in models.behaviour_report(reports, deltas, issue(("b", "t", "TRIGGER_SENSITIVITY")), issue(("b", "t", "TRIGGER_SENSITIVITY"), ("c", "t", "OUTPUT_NONFINITE"))).collect()}
    assert (got["a"].state, got["a"].codes) == ("CHANGED", []) and (got["b"].state, got["b"].codes) == ("SAME", ["PERSISTING_TRIGGER_SENSITIVITY"])
    assert (got["c"].status, got["c"].state, got["c"].codes, got["c"].limitations) == ("PARTIAL", "UNAVAILABLE", ["NEW_OUTPUT_NONFINITE"], ["BEHAVIORAL_EVIDENCE_PARTIAL"])
    capped = {r.model_id: r.limitations for r in models.behaviour_report(reports, deltas, issue(), issue(), most=1).collect()}
    assert capped["a"] == ["BEHAVIORAL_EVIDENCE_PARTIAL", "BEHAVIOR_TRIGGER_DELTAS_TRUNCATED"]


def test_chains_are_folded_row_by_row(spark):
    """A task holds a batch of a chain's rows, and many chains are one pass: no group is handed over whole."""
    n = 30_000
    plain = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("long")).otherwise(F.concat(F.lit("c"), (F.col("id") % 5000).cast("string"))).alias("chain"), F.lit("E").alias("event_type"), F.lit("t").alias("asset_type"), F.col("id").cast("string").alias("asset_id"), F.lit('{"k":"é\\""}').alias("payload_json"), F.timestamp_seconds("id").alias("ts"), "id")
    log = audit.build(plain, "chain", ("ts",), keep=("id",))
    kinds = log._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in kinds and "FlatMapGroups" not in kinds
    assert log.where("chain = 'long'").count() == n // 3
    assert {(r.status, r.first_broken) for r in audit.verify(log).collect()} == {("VALID", None)}
    before, rows = audit.GENESIS, log.where("chain = 'c7'").orderBy("sequence").collect()
    for i, r in enumerate(rows, 1):
        record = {f: r[f] for f in ("asset_id", "asset_type", "audit_id", "event_type", "payload_json", "sequence", "timestamp")} | {"previous_hash": before}
        before = hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        assert (r.sequence, r.current_hash) == (i, before)
    more = audit.build(plain.where("id < 9"), "chain", ("ts",), audit.heads(log), ("id",))
    assert {(r.status, r.first_broken) for r in audit.verify(log.unionByName(more)).collect()} == {("VALID", None)}


def test_choices_of_blocks_are_one_literal(spark):
    """The plan of a near join does not grow with the number of choices, and nothing is broadcast."""
    df = spark.range(50).select(F.col("id").alias("k"), F.xxhash64("id").alias("s"))
    plans = [detect.near_candidates(df, "k", "s", 10, blocks)._jdf.queryExecution().analyzed().toString() for blocks in (11, 14)]
    assert all(p.count("named_struct") == 0 and p.count("struct(mask") == 0 for p in plans)
    classes = detect.near_classes(df, "k", "s")
    assert "BroadcastHashJoin" not in classes._jdf.queryExecution().executedPlan().toString()


def test_references_are_counted_by_more_tasks_where_rows_are_more(spark, monkeypatch):
    from collections import Counter

    from proofline.operators import annotations

    images = [(i,) for i in range(40)] + [(3,), (None,), (None,)]
    categories = [(i,) for i in range(5)] + [(2,)]
    notes = [(i % 390, None if i % 50 == 9 else i % 47, 1 if i % 2 else i % 7) for i in range(400)]  # one category is very frequent
    frames = (spark.createDataFrame(images, "id long"), spark.createDataFrame(categories, "id long"), spark.createDataFrame(notes, "id long, image_id long, category_id long"))
    want = set()
    for name, ids, refs in (("IMAGE", images, [n[1] for n in notes]), ("CATEGORY", categories, [n[2] for n in notes]), ("ANNOTATION", notes, [])):
        text = lambda x: None if x is None else str(x)
        want |= {(f"DUPLICATE_{name}_ID", text(i), n) for i, n in Counter(r[0] for r in ids).items() if n > 1}
        want |= {(f"ORPHAN_{name}", text(i), n) for i, n in Counter(refs).items() if i is None or i not in {r[0] for r in ids}}
    few = annotations.reference_violations(*frames)
    assert {(r.violation, r.subject, r.n) for r in few.collect()} == want and few.count() == len(want)
    monkeypatch.setattr(annotations, "ROWS", 5)
    many = annotations.reference_violations(*frames)
    assert {(r.violation, r.subject, r.n) for r in many.collect()} == want and many.count() == len(want)
    plan = many._jdf.queryExecution().executedPlan().toString()
    # 443, 406 and 400 rows, five to a task; no other exchange puts all of them into the session's partitions
    assert all(f", {n // 5 + 1}), REPARTITION_BY_NUM" in plan for n in (443, 406, 400)) and "ENSURE_REQUIREMENTS" not in plan
