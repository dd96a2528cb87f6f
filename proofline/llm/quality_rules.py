"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document and leaves one bit; the measurements stay beside the bits, so any later
policy (a named, versioned set of rules) and any ablation is bit arithmetic over the ledger, without the texts.

Main path: DataFrame functions only. Defined cases: a null text has no words (all measures 0, ``too_few_words``
fails); an empty text likewise; repeated rows are judged one by one; an empty table gives an empty ledger; columns of
the input that clash with a ledger column are replaced by the ledger's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body`` as often as needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds at least twice."""
    windows = lambda w: F.sequence(F.lit(0), F.size(w) - 3)

    def covered(w: Column) -> Column:
        named = F.transform(windows(w), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")))
        twice = lambda s: F.filter(s, lambda x, k: (x["t"] == F.coalesce(F.get(s, k - 1)["t"], F.lit(""))) | (x["t"] == F.coalesce(F.get(s, k + 1)["t"], F.lit(""))))
        starts = let(F.sort_array(named), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    prints = F.transform(windows(words), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    # equal windows have equal fingerprints: without a repeated one there is nothing to compare
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(prints, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(words)))).cast("long")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """All measurements of a text, each taken once, as columns beside the input's."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    count = lambda pattern: F.length(F.regexp_replace(whole, pattern, "")).cast("long")
    taken = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper"}
    return df.select(
        *(c for c in df.columns if c.lower() not in taken),
        of_words.alias("_w"),
        of_lines.alias("_l"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        count(r"[^\p{L}]+").alias("n_letters"),
        count(r"[^\p{Lu}]+").alias("n_upper"),
    ).select(
        *(c for c in df.columns if c.lower() not in taken),
        *(f"_w.{c}" for c in ("n_words", "word_chars", "n_repeat_words")),
        *(f"_l.{c}" for c in ("n_lines", "n_dup_lines")),
        "n_symbols",
        "n_letters",
        "n_upper",
    )


@dataclass(frozen=True)
class Rule:
    """A named failure condition in SQL over the measurements; integer arithmetic, so every engine agrees."""

    name: str
    fails: str


#: The position in this tuple is the rule's bit for ever: append, never reorder.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("shouting", "100 * n_upper > 50 * n_letters"),
    Rule("few_letters", "100 * n_letters < 50 * word_chars"),
    Rule("mostly_repeated_lines", "n_dup_lines > 4 AND 2 * n_dup_lines > n_lines"),
)
BASE = ("too_few_words", "repeated_windows")
#: Named policies: the rules that reject a document. A published version is never edited.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbol_heavy", "duplicate_lines", "shouting"),
    "v2": (*BASE, "symbol_heavy", "duplicate_lines", "short_words", "long_words", "shouting", "few_letters"),
    # a refrain of a few lines is no template: only long repetition counts
    "v3": (*BASE, "symbol_heavy", "mostly_repeated_lines", "short_words", "long_words", "shouting", "few_letters"),
}
CURRENT = "v3"


def mask(rules: tuple[str, ...]) -> int:
    """The bits of some rules."""
    known = {r.name: 1 << i for i, r in enumerate(RULES)}
    return sum(known[name] for name in set(rules))


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """The input with its measurements and ``failure_bits``, one bit per rule of ``RULES``."""
    found = measure(df, text)
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return found.drop("failure_bits").withColumn("failure_bits", bits)


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with ``base_failed`` and ``kept`` under one policy; only bits are read."""
    hit = lambda name: F.col("failure_bits").bitwiseAND(F.lit(mask(POLICIES[name]) | mask(BASE)).cast("long")) != 0
    return entries.drop("base_failed", "kept").withColumns({"base_failed": hit("base"), "kept": ~hit(policy)})


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: how many fail it, how many it alone rejects, and how many would stay without it.

    The ledger is first counted by bit pattern (at most 2 ** number of rules rows), so nothing else is shuffled.
    An empty ledger gives counts of 0.
    """
    whole = mask(POLICIES[policy])
    patterns = entries.groupBy(F.col("failure_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    has = lambda bit: F.col("bits").bitwiseAND(F.lit(bit).cast("long")) != 0
    rows = [
        F.struct(
            F.lit(r.name).alias("rule"),
            total(has(mask((r.name,)))).alias("n_failed"),
            total(F.col("bits") == mask((r.name,))).alias("n_only"),
            total(F.col("bits").bitwiseAND(F.lit(whole & ~mask((r.name,))).cast("long")) == 0).alias("n_kept_without"),
        )
        for r in rules
    ]
    seen = F.coalesce(F.bit_or("bits"), F.lit(0).cast("long"))
    return patterns.agg(F.array(*rows).alias("r"), seen.alias("bits_seen")).select(F.explode("r").alias("r"), "bits_seen").select("r.*", "bits_seen")


def query(spark, sf_dir: str) -> DataFrame:
    """Rules over all documents, under the current policy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_policy(ledger(docs.select("doc_id", "text"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         row_number() OVER () AS rid
  FROM documents),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper
  FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines > 4 AND 2 * n_dup_lines > n_lines) OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR 100 * n_upper > 50 * n_letters OR 100 * n_letters < 50 * word_chars) AS kept
FROM b
"""
