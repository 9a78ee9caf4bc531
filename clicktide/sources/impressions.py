"""Impression logs: text lines to one row per ad slot.

A line holds TAB-separated segments `show click id:slot id:slot ..`. A lone segment is a slot by
itself. With more, segment 0 carries features shared by all later segments and is no slot.
Everything here is narrow: no shuffle, and no Python but in the scan that numbers lines by offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clicktide.functions.scalar import parse_unsigned
from clicktide.sources.bytelines import SPLIT_BYTES, ByteLines

MODES = ("FAILFAST", "DROPMALFORMED", "PERMISSIVE")
CORRUPT = "_corrupt_record"
# A slot name behind one of the first two tokens of a segment, which are counts.
NAMED_COUNT = "(?:^|\t)[^ \t:]*(?: [^ \t:]*)?:"


def read_lines(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """Text lines as `(req, value)`; `req` numbers lines by scan partition and position.

    `min_partitions` spreads the lines further if the scan alone yields fewer tasks.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("req"), "value")
    if min_partitions and lines.rdd.getNumPartitions() < min_partitions:
        lines = lines.repartition(min_partitions)
    return lines


# A line's number is that of its file in the upper bits and its first byte in the lower ones.
OFFSET_BITS = 40


def read_lines_by_offset(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Text lines as `(req, value)`; `req` is made of a line's file and offset.

    It is the same in every job that reads the same files, whatever their splits are. A carriage
    return ends a line only before a newline. Files beyond 1 TB, or the first 8 million, stop the job.
    """
    spark.dataSource.register(ByteLines)
    lines = spark.read.format("bytelines").option("splitBytes", split_bytes).load(path)
    fits = (F.col("offset") < 1 << OFFSET_BITS) & (F.col("file") < 1 << (63 - OFFSET_BITS))
    stop = F.raise_error(F.lit("file or offset too large for a line number")).cast("bigint")
    number = F.shiftleft(F.col("file").cast("bigint"), OFFSET_BITS) + F.col("offset")
    return lines.select(F.when(fits, number).otherwise(stop).alias("req"), "value")


def _clean(value: Column) -> Column:
    """Line text without trailing TABs (no segment), trailing blanks (no token), slot names."""
    text = F.rtrim(value, F.lit("\t"))
    loose = F.contains(text, F.lit(" \t")) | F.endswith(text, F.lit(" "))
    text = F.when(loose, F.regexp_replace(text, " +(?=\t|$)", "")).otherwise(text)
    return F.regexp_replace(text, ":[^ \t]*", "")


def _any_token(segments: str, test) -> Column:
    return F.exists(segments, lambda s: F.exists(s, test))


def _counts_ok(segment: Column) -> Column:
    """Show and click are there and fit 32 bits."""
    fits = lambda c: c.between(-(2**31), 2**31 - 1)
    return (F.size(segment) >= 2) & fits(F.get(segment, 0)) & fits(F.get(segment, 1))


def parse_requests(lines: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Parse `value`: one row per line with `segs ARRAY<ARRAY<BIGINT>>`, each segment being
    `[show, click, id, id, ..]`; other columns pass through.

    FAILFAST stops the job at a malformed line, DROPMALFORMED leaves such lines out, PERMISSIVE
    keeps them with NULL `segs` and the text in `_corrupt_record`.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    keep = [c for c in lines.columns if c != "value"]
    split = lines.withColumn("_text", _clean(F.col("value"))).withColumn(
        "_tokens", F.transform(F.split("_text", "\t"), lambda s: F.split(s, " "))
    )
    # One array cast converts all tokens of a line. NULLs mean ids from 2^63 up, or junk; only
    # such lines are read again token by token.
    fast = split.withColumn("_fast", F.col("_tokens").try_cast("array<array<bigint>>"))
    number = lambda t: F.coalesce(t.try_cast("bigint"), parse_unsigned(t))
    parsed = fast.withColumn(
        "_segs",
        F.when(
            _any_token("_fast", lambda x: x.isNull()),
            F.transform("_tokens", lambda s: F.transform(s, number)),
        ).otherwise(F.col("_fast")),
    )
    # A minus sign is legal in counts only; tokens are searched just in lines that have one.
    signed_id = F.contains("_text", F.lit("-")) & F.exists(
        "_tokens",
        lambda s: F.exists(
            F.slice(s, 3, F.greatest(F.size(s) - 2, F.lit(0))),
            lambda t: F.startswith(t, F.lit("-")),
        ),
    )
    ok = (
        ~F.col("_text").rlike("[^0-9+\\- \t]")
        & ~F.col("value").rlike(NAMED_COUNT)
        & ~_any_token("_segs", lambda x: x.isNull())
        & F.forall("_segs", _counts_ok)
        & ~signed_id
    )
    checked = parsed.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    if mode == "FAILFAST":
        message = F.concat(F.lit("malformed impression line: "), F.coalesce("value", F.lit("")))
        stop = F.raise_error(message).cast("array<array<bigint>>")
        return checked.select(*keep, F.when(F.col("_ok"), F.col("_segs")).otherwise(stop).alias("segs"))
    if mode == "PERMISSIVE":
        return checked.select(
            *keep,
            F.when(F.col("_ok"), F.col("_segs")).alias("segs"),
            F.when(~F.col("_ok"), F.col("value")).alias(CORRUPT),
        )
    # Dropping through a generated column: a plain filter would be pushed below the projections
    # above and parse every line once more.
    good = F.when(F.col("_ok"), F.array("_segs"))
    return checked.select(*keep, F.explode_outer(good).alias("segs")).filter(
        F.col("segs").isNotNull()
    )


def shared_features(segs: Column) -> Column:
    """Ids of segment 0 if more segments follow, else none."""
    head = F.get(segs, F.lit(0))
    return F.when(F.size(segs) > 1, segment_features(head)).otherwise(
        F.array().cast("array<bigint>")
    )


def segment_features(segment: Column) -> Column:
    return F.slice(segment, 3, F.size(segment) - 2)


def slot_segments(segs: Column) -> Column:
    """The segments that are slots: all but segment 0, or the only one."""
    return F.when(F.size(segs) > 1, F.slice(segs, 2, F.size(segs) - 1)).otherwise(segs)


def explode_slots(requests: DataFrame) -> DataFrame:
    """One row per slot: pass-through columns, `seg` (1..), `show`, `click`, `feats`, `common`.

    Corrupt lines kept by PERMISSIVE have no slots and so yield no rows.
    """
    keep = [c for c in requests.columns if c not in ("segs", CORRUPT)]
    segs = F.col("segs")
    # The outer form, because the inner one makes the optimizer test the parsed array a second
    # time below the parse.
    slots = requests.select(
        *keep,
        shared_features(segs).alias("common"),
        F.posexplode_outer(slot_segments(segs)).alias("_pos", "_slot"),
    ).filter(F.col("_slot").isNotNull())
    slot = F.col("_slot")
    return slots.select(
        *keep,
        (F.col("_pos") + 1).alias("seg"),
        F.get(slot, F.lit(0)).cast("int").alias("show"),
        F.get(slot, F.lit(1)).cast("int").alias("click"),
        segment_features(slot).alias("feats"),
        "common",
    )


def parse_impressions(lines: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """`parse_requests` and `explode_slots` in one go."""
    return explode_slots(parse_requests(lines, mode))


def read_impressions(
    spark: SparkSession,
    path: str,
    mode: str = "FAILFAST",
    min_partitions: int | None = None,
    by_offset: bool = False,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Impression rows `(req, seg, show, click, feats, common)` from a log of text files.

    `by_offset` numbers requests by their place in the files (`read_lines_by_offset`), for jobs that
    must agree on them; the scan is then a Python one, in ranges of `split_bytes`.
    """
    if by_offset:
        return parse_impressions(read_lines_by_offset(spark, path, split_bytes), mode)
    return parse_impressions(read_lines(spark, path, min_partitions), mode)
