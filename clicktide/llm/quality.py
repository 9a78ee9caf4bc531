"""Quality rules as a ledger of failure bits, with versioned policies and their ablations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from clicktide.llm.text import MIX_2, WORD_BASE, Slice, Spans, measured, mix

WINDOW = 8

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_words",
]

# Rule of each bit: the condition on the measures under which a document fails, in SQL.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    # One or two lines that come twice are no reason in a short text.
    "duplicate_lines": "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 15 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "same_words": "100 * n_same_words > 40 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

# Policies are only added, never changed: a stored ledger can be judged by any of them.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "duplicate_lines"],
    "v2": list(RULES),
}
POLICY = "v2"


def _counts(part: Slice) -> list:
    words = np.diff(part.word_bounds)
    first_byte = (part.raw & 0xC0) != 0x80
    chars = part.per_doc(part.in_word & first_byte)
    symbols = part.per_doc(SYMBOL[part.raw])
    spans = part.bytes_hashed()

    newline = np.flatnonzero(part.raw == 10)
    starts = np.sort(np.concatenate([part.bounds[:-1], newline + 1]))
    ends = np.sort(np.concatenate([newline, part.bounds[1:]]))
    line_doc = np.repeat(np.arange(part.n), part.per_doc(part.raw == 10) + 1)
    full = np.searchsorted(part.starts, starts) < np.searchsorted(part.starts, ends)
    starts, ends, line_doc = starts[full], ends[full], line_doc[full]
    lines = np.bincount(line_doc, minlength=part.n)
    salt = mix(np.arange(part.n, dtype=np.uint64) + np.uint64(MIX_2))
    _, once = np.unique(spans.hashes(starts, ends) ^ salt[line_doc], return_index=True)
    dup_lines = lines - np.bincount(line_doc[once], minlength=part.n)

    word = spans.hashes(part.starts, part.ends)
    same_word = np.zeros(len(word), bool)
    same_word[1:] = (word[1:] == word[:-1]) & (part.doc[1:] == part.doc[:-1])
    same_words = part.per_doc(same_word, part.word_bounds)

    at = part.windows(WINDOW)
    hashes = Spans(word, WORD_BASE).hashes(at, at + WINDOW)
    hashes ^= salt[part.doc[at]]
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(part.doc) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    repeated = part.per_doc(np.cumsum(edge[:-1]) > 0, part.word_bounds)
    return [words, chars, symbols, dup_lines, repeated, lines, same_words]


def fail_bits() -> Column:
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0) for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total.cast("long")


def ledger(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with every measure and `fail_bits`: bit i is set if rule i of RULES fails.

    Each rule is evaluated once. One narrow pass over `text`, without a shuffle; windows and lines
    are compared by 64-bit hashes. Null and empty texts have no words and fail `few_words`.
    Repeated rows are judged alike. Columns of `docs` named like an added one are replaced; those
    in `drop` are left out.
    """
    fields = [(name, "long") for name in MEASURES]
    return measured(docs, fields, _counts, drop=(*drop, "fail_bits")).withColumn("fail_bits", fail_bits())


def mask(policy: str) -> int:
    return sum(BIT[rule] for rule in POLICIES[policy])


def kept(policy: str = POLICY) -> Column:
    """Whether a ledger's row passes `policy`; reads only `fail_bits`."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """`(rule, n_failed, n_only)`: documents that fail a rule, and those that only it rejects.

    Failure patterns are counted first, so that the table of documents is read once and at most
    2 ** rules rows are looked at by rule.
    """
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    patterns = rows.select(bits.alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rule = F.explode(
        F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]))
    ).alias("r")
    by_rule = patterns.select("bits", "n", rule).select("bits", "n", "r.rule", "r.bit")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return by_rule.groupBy("rule").agg(
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op3_quality(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    rows = ledger(docs, drop=("text",))
    return rows.select(
        "doc_id", *MEASURES, "fail_bits", base.alias("base_failed"), kept().alias("kept")
    )


def _sql(docs: str) -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))
    return f"""
d AS (SELECT row_number() OVER () AS r, * FROM {docs}),
w AS (
  SELECT r, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM d)
), g AS (
  SELECT r, i, word,
         CASE WHEN i + {WINDOW - 1} <= count(*) OVER (PARTITION BY r)
              THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
         END AS gram
  FROM w
), c AS (
  SELECT *, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY r, gram) > 1 THEN 1 ELSE 0 END AS twice FROM g
), v AS (
  SELECT r, word, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS rep,
         coalesce(lag(word) OVER (PARTITION BY r ORDER BY i) = word, FALSE) AS same FROM c
), a AS (
  SELECT r, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, CAST(sum(rep) AS BIGINT) AS n_repeat_words,
         count(*) FILTER (same) AS n_same_words
  FROM v GROUP BY r
), l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
), m AS (
  SELECT d.*, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_same_words, 0) AS n_same_words
  FROM d LEFT JOIN a USING (r) LEFT JOIN l USING (r)
), quality AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)"""


OP3_SQL = f"""WITH {_sql("documents")}
SELECT doc_id, {", ".join(MEASURES)}, fail_bits, (fail_bits & {mask("base")}) <> 0 AS base_failed,
       (fail_bits & {mask(POLICY)}) = 0 AS kept FROM quality"""
