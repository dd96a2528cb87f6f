"""Catalogue: window profiles and their comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import compare, profile
from proofline.plans.derived import commitment_sql
from proofline.session import table

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
KEYS = ("l_returnflag", "feature")
BINS = 20


def _lines(spark, sf_dir):
    role = F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"), "REFERENCE").otherwise("CURRENT")
    return table(spark, sf_dir, "lineitem").withColumn("role", role)


def _values(spark, sf_dir):
    return profile.long_form(_lines(spark, sf_dir), FEATURES, ("l_returnflag", "role"))


def _unit(spark, sf_dir):
    """Discounts and taxes, tenfold, so that they spread over [0, 1]."""
    return _values(spark, sf_dir).where(F.col("feature").isin("l_discount", "l_tax")).withColumn("value", F.col("value") * 10)


def numeric_profile(spark, sf_dir):
    found = profile.numeric_profile(_values(spark, sf_dir), (*KEYS, "role"))
    return found.select(*KEYS, "role", "count", *(F.round(c, 6).alias(c) for c in profile.SUMMARY[1:]))


def histogram_profile(spark, sf_dir):
    found = profile.dense(profile.histogram(_unit(spark, sf_dir), (*KEYS, "role"), BINS), (*KEYS, "role"), BINS)
    return found.select(*KEYS, "role", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"))


def _categories(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("role", F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), "REFERENCE").otherwise("CURRENT"))
    return profile.category_counts(orders, ("o_orderstatus", "role"), "o_orderpriority", 4)


def category_profile(spark, sf_dir):
    return _categories(spark, sf_dir)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("code", F.when(F.col("value") < 1, "TOO_SMALL")).withColumn("path", F.format_string("%012d", "event_id"))


def profile_status(spark, sf_dir):
    return profile.window_status(_events(spark, sf_dir), ("event_type",), "path", "code", 2400)


def profile_failures(spark, sf_dir):
    return profile.failures(_events(spark, sf_dir), ("event_type",), "path", "code")


def window_commitment(spark, sf_dir):
    return profile.commitment(_events(spark, sf_dir), ("event_type",), F.concat_ws("|", "path", "props"))


def _distances(spark, sf_dir):
    return compare.divergences(profile.histogram(_unit(spark, sf_dir), (*KEYS, "role"), BINS), KEYS, "bin", BINS)


def _continuous(spark, sf_dir):
    return compare.continuous(profile.numeric_profile(_values(spark, sf_dir), (*KEYS, "role")), KEYS, _distances(spark, sf_dir))


def shift_continuous(spark, sf_dir):
    value = lambda i: F.round(F.get("metrics", F.lit(i))["value"], 6)
    return _continuous(spark, sf_dir).select(*KEYS, *(value(i).alias(n) for i, n in enumerate(("smd", "quantile", "median", "js", "tv", "wasserstein"))), "exceeded", "state", "direction")


def shift_categorical(spark, sf_dir):
    return compare.categorical(_categories(spark, sf_dir), ("o_orderstatus",)).select("o_orderstatus", "n_ref", "n_cur", F.round("js", 9).alias("js"), F.round("tv", 9).alias("tv"), "state", "direction")


def shift_report(spark, sf_dir):
    return compare.report(_continuous(spark, sf_dir), ("l_returnflag",))


_V = """
l AS (SELECT *, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'REFERENCE' ELSE 'CURRENT' END AS role FROM lineitem),
v AS (SELECT l_returnflag, role, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM l),
u AS (SELECT l_returnflag, role, feature, value * 10 AS value FROM v WHERE feature IN ('l_discount', 'l_tax')),
h AS (SELECT l_returnflag, role, feature, least(floor(value * 20), 19)::INTEGER AS bin, count(*) AS n FROM u WHERE value BETWEEN 0 AND 1 GROUP BY ALL),
p AS (SELECT l_returnflag, feature, role, count(*) AS count, min(value) AS minimum, max(value) AS maximum, avg(value) AS mean, stddev_pop(value) AS std,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS q95 FROM v GROUP BY ALL)"""
_STATE = (
    _V
    + """,
k AS (SELECT DISTINCT l_returnflag, feature FROM h),
g AS (SELECT k.*, b.bin, coalesce(x.n, 0)::DOUBLE AS a, coalesce(y.n, 0)::DOUBLE AS c FROM k CROSS JOIN range(0, 20) b(bin)
  LEFT JOIN h x ON x.l_returnflag = k.l_returnflag AND x.feature = k.feature AND x.bin = b.bin AND x.role = 'REFERENCE'
  LEFT JOIN h y ON y.l_returnflag = k.l_returnflag AND y.feature = k.feature AND y.bin = b.bin AND y.role = 'CURRENT'),
s AS (SELECT *, a / sum(a) OVER w AS p, c / sum(c) OVER w AS q FROM g WINDOW w AS (PARTITION BY l_returnflag, feature)),
r AS (SELECT *, abs(sum(p - q) OVER (PARTITION BY l_returnflag, feature ORDER BY bin)) AS d FROM s),
d AS (SELECT l_returnflag, feature, sum(((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2) AS js, sum(abs(p - q)) / 2 AS tv, sum(d) / 20 AS wasserstein FROM r GROUP BY ALL),
m AS (SELECT x.l_returnflag, x.feature, abs(y.mean - x.mean) / sqrt((x.std ^ 2 + y.std ^ 2) / 2) AS smd,
  greatest(abs(y.q05 - x.q05), abs(y.q25 - x.q25), abs(y.median - x.median), abs(y.q75 - x.q75), abs(y.q95 - x.q95)) / greatest(x.q95 - x.q05, y.q95 - y.q05) AS quantile,
  CASE WHEN abs(x.median) + abs(y.median) > 1e-12 THEN 2 * abs(y.median - x.median) / (abs(x.median) + abs(y.median)) ELSE 0 END AS median, x.count AS n_ref, y.count AS n_cur,
  CASE WHEN abs(y.median - x.median) <= 1e-12 THEN 'SAME' WHEN y.median > x.median THEN 'INCREASED' ELSE 'DECREASED' END AS direction
  FROM p x JOIN p y ON x.l_returnflag = y.l_returnflag AND x.feature = y.feature AND x.role = 'REFERENCE' AND y.role = 'CURRENT'),
e AS (SELECT m.*, js, tv, wasserstein, (smd >= 0.8)::INT + (quantile >= 0.5)::INT + (median >= 0.25)::INT + coalesce((js >= 0.1)::INT, 0) + coalesce((tv >= 0.25)::INT, 0) + coalesce((wasserstein >= 0.1)::INT, 0) AS exceeded FROM m LEFT JOIN d USING (l_returnflag, feature)),
z AS (SELECT *, CASE WHEN n_ref < 20 OR n_cur < 20 THEN 'INSUFFICIENT' WHEN exceeded >= 2 THEN 'SHIFTED' ELSE 'STABLE' END AS state FROM e)"""
)
_C = """
o AS (SELECT o_orderstatus, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'REFERENCE' ELSE 'CURRENT' END AS role, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, role ORDER BY value) AS r, count(*) OVER (PARTITION BY o_orderstatus, role) AS k FROM o),
c AS (SELECT o_orderstatus, role, CASE WHEN k > 4 AND r >= 4 THEN 'OTHER' ELSE value END AS value, sum(n)::BIGINT AS n FROM r GROUP BY ALL)"""
_E = "e AS (SELECT *, CASE WHEN value < 1 THEN 'TOO_SMALL' END AS code, printf('%012d', event_id) AS path FROM events)"

QUERIES = {
    "numeric_profile": (numeric_profile, f"WITH {_V} SELECT l_returnflag, feature, role, count, " + ", ".join(f"round({c}, 6) AS {c}" for c in profile.SUMMARY[1:]) + " FROM p"),
    "histogram_profile": (
        histogram_profile,
        f"WITH {_V}, k AS (SELECT DISTINCT l_returnflag, feature, role FROM h) SELECT k.l_returnflag, k.feature, k.role, array_to_string(list(coalesce(n, 0) ORDER BY b.bin), ',') AS counts FROM k CROSS JOIN range(0, 20) b(bin) LEFT JOIN h ON h.l_returnflag = k.l_returnflag AND h.feature = k.feature AND h.role = k.role AND h.bin = b.bin GROUP BY ALL",
    ),
    "category_profile": (category_profile, f"WITH {_C} SELECT * FROM c"),
    "profile_status": (
        profile_status,
        f"WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY path) <= 2400 AS i FROM e), s AS (SELECT event_type, count(*) AS discovered, count(*) FILTER (i) AS selected, count(*) FILTER (i AND code IS NULL) AS profiled, count(*) FILTER (i AND code IS NOT NULL) AS failed FROM r GROUP BY event_type) SELECT *, discovered - selected AS skipped, CASE WHEN profiled = 0 THEN 'UNAVAILABLE' WHEN failed > 0 OR discovered > selected THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, concat_ws(',', CASE WHEN failed > 0 THEN 'FAILED_SAMPLES' END, CASE WHEN discovered > selected THEN 'WINDOW_TRUNCATED' END) AS limitations FROM s",
    ),
    "profile_failures": (profile_failures, f"WITH {_E}, r AS (SELECT event_type, path, code, row_number() OVER (PARTITION BY event_type ORDER BY path, code) AS rank FROM e WHERE code IS NOT NULL) SELECT * FROM r WHERE rank <= 20"),
    "window_commitment": (
        window_commitment,
        f"""WITH {_E}, {commitment_sql("e", "event_type", "path || '|' || props")} SELECT * FROM hash_tree""",
    ),
    "shift_continuous": (shift_continuous, f"WITH {_STATE} SELECT l_returnflag, feature, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("smd", "quantile", "median", "js", "tv", "wasserstein")) + ", exceeded, state, direction FROM z"),
    "shift_categorical": (
        shift_categorical,
        f"WITH {_C}, k AS (SELECT DISTINCT o_orderstatus, value FROM c), g AS (SELECT k.*, coalesce(x.n, 0)::DOUBLE AS a, coalesce(y.n, 0)::DOUBLE AS b FROM k LEFT JOIN c x ON x.o_orderstatus = k.o_orderstatus AND x.value = k.value AND x.role = 'REFERENCE' LEFT JOIN c y ON y.o_orderstatus = k.o_orderstatus AND y.value = k.value AND y.role = 'CURRENT'), s AS (SELECT *, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q FROM g WINDOW w AS (PARTITION BY o_orderstatus)), d AS (SELECT o_orderstatus, sum(a)::BIGINT AS n_ref, sum(b)::BIGINT AS n_cur, sum(((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2) AS js, sum(abs(p - q)) / 2 AS tv FROM s GROUP BY ALL) SELECT o_orderstatus, n_ref, n_cur, round(js, 9) AS js, round(tv, 9) AS tv, CASE WHEN n_ref < 20 OR n_cur < 20 THEN 'INSUFFICIENT' WHEN js >= 0.1 AND tv >= 0.25 THEN 'SHIFTED' ELSE 'STABLE' END AS state, CASE WHEN tv > 1e-12 THEN 'MIXED' ELSE 'SAME' END AS direction FROM d",
    ),
    "shift_report": (
        shift_report,
        f"WITH {_STATE}, q AS (SELECT l_returnflag, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (state = 'SHIFTED'), '') AS shifted, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (state = 'STABLE'), '') AS stable, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (state = 'INSUFFICIENT'), '') AS not_assessed, CASE WHEN bool_or(state = 'INSUFFICIENT') THEN 'FEATURE_INSUFFICIENT' ELSE '' END AS limitations, CASE WHEN count(*) FILTER (state <> 'INSUFFICIENT') = 0 THEN 'UNAVAILABLE' WHEN bool_or(state = 'INSUFFICIENT') THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM z GROUP BY l_returnflag) SELECT *, sha256(shifted || '|' || stable || '|' || not_assessed || '|' || status) AS report_id FROM q",
    ),
}
