"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from clicktide.llm.storage import numbered, stored

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 42

# Columns that `mix` adds.
ADDED = ("size", "source_size", "target", "copies", "taken")

WORD = r"[^\x20\x09-\x0D]+"
# The random offset has so many binary digits, so that adding it to a whole number is exact.
OFFSET_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """`(source, source_size, target)` of `sizes` (source, size).

    Weights repeat along the sources by code point, null last. Together the targets are the total
    size. A target above `max_copies` times its source's size is cut to that, and what is cut
    goes to the other sources by weight until no target is above. Each round is one aggregate
    over the table of sources; more sources are at their limit after each round but the last.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = F.array(*(F.lit(w) for w in weights))
    place = (F.col("_place") % len(weights) + 1).cast("int")
    sources = stored(
        numbered(totals, [F.col("source").asc_nulls_last()], "_place").select(
            "source", "source_size", F.element_at(table, place).cast("long").alias("weight")
        )
    )

    def exact(c) -> Column:
        return (c if isinstance(c, Column) else F.lit(Decimal(c))).cast("decimal(19,0)")

    most = F.col("source_size") * max_copies
    free, over, n_full = F.lit(True), F.lit(False), -1
    while True:
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(over, most)).alias("cut"),
            F.sum(F.when(free, F.col("weight"))).alias("weight"),
            F.count(F.when(over, 1)).alias("full"),
        ).first()
        share, weight = (row.total or 0) - (row.cut or 0), row.weight or 0
        if row.full == n_full or not weight:
            break
        n_full = row.full
        over = exact(most) * exact(weight) < exact(share) * exact(F.col("weight"))
        free = ~over
    if weight:
        rest = F.lit(float(share)) * F.col("weight") / F.lit(float(weight))
    else:
        rest = most.cast("double")
    target = F.when(over, most.cast("double")).otherwise(rest)
    return sources.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
) -> DataFrame:
    """`docs` with `size, source_size, target, copies, taken`: how often the mix takes each row.

    Systematic sampling: every document of a source expects `target / source_size` copies. Along
    the documents of a source, sorted by size so that each stretch has long and short ones in
    proportion, the expected copies are summed up; a document is taken once for each whole number
    that its part of the sum, moved by the source's random offset, crosses. Therefore the copies
    differ from what is expected by less than one, and those of any stretch of a source too.

    The offset depends on `seed` and the source alone, and the order on size and doc_id, so that
    reruns agree. Null texts and texts without a word have size 0 and add nothing. A null source
    is a source. Rows that repeat are documents of their own; rows of equal source, size and
    doc_id share out their copies in any order. An empty table gives an empty table. `docs` may
    have more columns, which are kept; those named like an added one are replaced.
    """
    shared = share_out(docs.withColumn("_size", n_words(F.col("text"))), weights, max_copies, seed)
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    return shared.select(*keep, *(F.col(f"_{c}").alias(c) for c in ADDED))


def share_out(sized: DataFrame, weights, max_copies, seed) -> DataFrame:
    """`sized` (doc_id, source, _size, ..) with `_source_size, _target, _copies, _taken`."""
    order = [F.col("source").asc_nulls_last(), F.col("_size"), F.col("doc_id")]
    ranked = numbered(sized, order, "_n")
    firsts = ranked.groupBy("source").agg(F.min("_n").alias("_first"))
    targets = source_targets(ranked.select("source", F.col("_size").alias("size")), weights, max_copies)
    t, f = targets.alias("t"), firsts.alias("f")
    bounds = t.join(f, F.col("t.source").eqNullSafe(F.col("f.source"))).select(
        F.col("t.source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_first"
    )
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))
    digits = F.conv(F.substring(F.md5(named), 1, OFFSET_DIGITS), 16, 10).cast("double")
    offset = digits / F.lit(float(16**OFFSET_DIGITS))
    expected = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    rank = (F.col("_n") - F.col("_first")).cast("double")
    crossed = F.floor(expected * (rank + 1) + offset) - F.floor(expected * rank + offset)
    return (
        ranked.join(bounds, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_copies", crossed.cast("long"))
        .withColumn("_taken", F.col("_copies") * F.col("_size"))
        .drop("_n", "_first", "_source")
    )


def mixed(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED
) -> DataFrame:
    """The mix itself: rows of `docs` with all their columns, each as often as `mix` takes it."""
    sized = docs.withColumn("_size", n_words(F.col("text")))
    rows = share_out(sized, weights, max_copies, seed).filter(F.col("_copies") > 0)
    repeat = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")
    return rows.select(*docs.columns, repeat).drop("_copy")


# Sources numbered by code point share the total by weight; a cut-off is found by trying how many
# sources, in the order of 3 * size / weight, are at their limit. Sums use DOUBLE only at the end.
MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM {{docs}}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS INT) + 1] AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total,
         sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, encode(source) NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free_weight,
         coalesce(sum(3 * source_size) OVER (
           ORDER BY CAST(3 * source_size AS DOUBLE) / weight, encode(source) NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut
  FROM s
), c AS (
  SELECT CAST(total - cut AS BIGINT) AS share, CAST(free_weight AS BIGINT) AS weight
  FROM o WHERE 3 * source_size * free_weight >= (total - cut) * weight
  ORDER BY CAST(3 * source_size AS DOUBLE) / o.weight, encode(source) NULLS LAST LIMIT 1
), t AS (
  SELECT s.source, s.source_size,
         CASE WHEN 3 * s.source_size * c.weight < c.share * s.weight THEN CAST(3 * s.source_size AS DOUBLE)
              ELSE CAST(c.share AS DOUBLE) * s.weight / CAST(c.weight AS DOUBLE) END AS target,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(s.source, '')), 1, {OFFSET_DIGITS}) AS INT)
           / CAST({16**OFFSET_DIGITS} AS DOUBLE) AS u
  FROM s, c
), r AS (
  SELECT d.*, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS DOUBLE) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), m AS (
  SELECT *, CAST(floor(e * n + u) - floor(e * (n - 1) + u) AS BIGINT) AS copies FROM r
)
"""

OP9_SQL = MIX_SQL.format(docs="documents") + (
    "SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM m"
)


def op9_mix(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("_size"))
    rows = share_out(sized, WEIGHTS, MAX_COPIES, SEED)
    return rows.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("size", "source_size", "target", "taken", "copies")))
