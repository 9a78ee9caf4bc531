"""Exposure histograms of features, and the dictionary built from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clicktide.functions.numbering import number_rows
from clicktide.operators.sketch import WIDTH, exposure_sketch, possible_counts
from clicktide.session import materialise
from clicktide.sources.impressions import segment_features, shared_features, slot_segments

DEFAULT_THRESHOLD = 1000

# Pairs (request, feature) of three numbers each that may travel to every task.
BROADCAST_MAX_PAIRS = 1_000_000


def feature_histogram(impressions: DataFrame) -> DataFrame:
    """`(fid, n)`: how often each feature was shown, summed over slots and repeats. NULL ids, and
    NULL lists, are no features.

    One shuffle of partial sums; a hot feature arrives as one row per task.
    """
    none = F.array().cast("array<bigint>")
    fids = F.explode_outer(F.concat(F.coalesce("feats", none), F.coalesce("common", none))).alias("fid")
    shown = impressions.select("show", fids).filter(F.col("fid").isNotNull())
    return shown.groupBy("fid").agg(F.sum(F.col("show").cast("bigint")).alias("n"))


def frequent_sketched(
    impressions: DataFrame, threshold: int = DEFAULT_THRESHOLD, width: int = WIDTH, tasks: int | None = None
) -> DataFrame:
    """`frequent(feature_histogram(impressions), threshold)`, shuffling few of the rare features.

    A first pass sketches the counts, a second one adds up exactly, but only features whose count may be
    above the threshold leave their task. Where the input is so large that the sketch would let
    most features pass, the second pass is the plain histogram. Impressions are read twice.
    """
    sketch = exposure_sketch(impressions, width=width, tasks=tasks)
    if sketch.share_above(threshold) > 0.5:
        return frequent(feature_histogram(impressions), threshold)
    parts = possible_counts(impressions, sketch, threshold)
    return frequent(parts.groupBy("fid").agg(F.sum("n").alias("n")), threshold)


def last_write_histogram(impressions: DataFrame, request: str = "req") -> DataFrame:
    """`(fid, n)` under the rule that, within a request, a slot's own feature replaces the count
    reached so far while a shared feature adds to it.

    With c occurrences in the shared part and L the last slot that owns the feature, a request
    counts c * (shows after slot L) + show of slot L. In a lone segment every distinct feature
    counts once, which is the same formula with c = 0.

    Shared features are first summed over all slots. Shows up to slot L are taken back for the
    features a request both shares and owns; those can be told from single rows and are few.
    """

    # Outer, then filtered: the inner form has the optimizer test the arrays below a parse again.
    def unfold(ids):
        rows = impressions.select(request, "seg", "show", F.explode_outer(ids).alias("fid"))
        return rows.filter(F.col("fid").isNotNull())

    shown = F.col("show").cast("bigint").alias("n")
    last = unfold("feats").groupBy(request, "fid").agg(F.max_by("show", "seg").alias("show"))
    parts = unfold("common").select("fid", shown).unionAll(last.select("fid", shown))
    both = materialise(
        unfold(F.array_intersect("feats", "common"))
        .groupBy(request, "fid")
        .agg(F.max("seg").alias("last_seg"))
    )
    pairs = both.limit(BROADCAST_MAX_PAIRS + 1).count()
    if pairs:
        side = F.broadcast(both) if pairs <= BROADCAST_MAX_PAIRS else both
        early = unfold("common").join(side, [request, "fid"]).filter("seg <= last_seg")
        parts = parts.unionAll(early.select("fid", -shown))
    return parts.groupBy("fid").agg(F.sum("n").alias("n"))


def last_write_request_histogram(requests: DataFrame) -> DataFrame:
    """`last_write_histogram` on parsed lines `(segs)`, without grouping by line first.

    A line contributes its total shows per shared occurrence and, per owned feature, show(L) - c *
    shows(1..L). Running sums of shows and the sorted ids of a line give all of these in a time that
    grows with the line's length, whatever it repeats.
    """
    # Behind a generator, or the optimizer would parse a line again for each use of its segments.
    parsed = requests.select(F.explode_outer(F.array("segs")).alias("segs"))
    lines = parsed.filter(F.col("segs").isNotNull()).select(
        shared_features(F.col("segs")).alias("common"),
        F.transform(slot_segments(F.col("segs")), lambda s: F.get(s, 0)).alias("shows"),
        F.transform(slot_segments(F.col("segs")), segment_features).alias("owned"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fid, n = _line_counts(*batch.columns)
            each, at = np.unique(fid, return_inverse=True)
            total = np.zeros(len(each), np.int64)
            np.add.at(total, at, n)
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(total)], ["fid", "n"])

    parts = lines.mapInArrow(run, "fid LONG, n LONG")
    return parts.groupBy("fid").agg(F.sum("n").alias("n"))


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each entry, entries) of a list column."""
    return np.repeat(np.arange(len(column)), np.diff(np.asarray(column.offsets))), column.flatten()


def _line_counts(common: pa.Array, shows: pa.Array, owned: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of a batch of lines under the replacing rule; features may repeat."""
    whole = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64)
    slot_line, show = _lists(shows)
    show = whole(show)
    running = np.cumsum(show)
    # Shows of a line up to and with each of its slots, and all of them.
    first = np.searchsorted(slot_line, np.arange(len(shows)))
    before = np.append(0, running)[first]
    upto = running - before[slot_line]
    total = np.append(0, running)[np.append(first[1:], len(show))] - before if len(shows) else before
    # Shared features of a line with their occurrences, sorted by line and id.
    line, fid = _lists(common)
    fid = whole(fid)
    order = np.lexsort((fid, line))
    line, fid = line[order], fid[order]
    start = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (fid[1:] != fid[:-1]))) if len(line) else line
    c_line, c_fid, c_n = line[start], fid[start], np.diff(np.append(start, len(line)))
    # The last slot of a line that owns a feature.
    slot, own = _lists(_lists(owned)[1])
    own = whole(own)
    order = np.lexsort((slot, own, slot_line[slot]))
    slot, own = slot[order], own[order]
    o_line = slot_line[slot]
    last = np.flatnonzero(np.append((o_line[1:] != o_line[:-1]) | (own[1:] != own[:-1]), True)) if len(own) else slot
    o_line, o_slot, o_fid = o_line[last], slot[last], own[last]
    # Both lists in one order: an owned feature behind the shared one of its line.
    lines, fids = np.concatenate([c_line, o_line]), np.concatenate([c_fid, o_fid])
    n_c = len(c_line)
    order = np.lexsort((np.arange(len(lines)), fids, lines))
    at = np.empty(len(lines), np.int64)
    at[order] = np.arange(len(lines))
    previous = order[np.maximum(at[n_c:] - 1, 0)]
    both = (previous < n_c) & (at[n_c:] > 0)
    both &= (lines[previous] == o_line) & (fids[previous] == o_fid)
    times = np.zeros(len(o_line), np.int64)
    times[both] = c_n[previous[both]]
    return fids, np.concatenate([c_n * total[c_line], show[o_slot] - times * upto[o_slot]])


def frequent(histogram: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Features shown strictly more than `threshold` times."""
    return histogram.filter(F.col("n") > threshold)


def number_features(histogram: DataFrame) -> DataFrame:
    """`(fid, n, dim)`: dims 1..K from the most to the least shown feature, ties by id.

    Dim 0 stays free for the bias.
    """
    order = [F.col("n").desc(), F.col("fid").asc()]
    numbered = number_rows(histogram.select("fid", "n"), order, "dim")
    return numbered.select("fid", "n", F.col("dim").cast("int").alias("dim"))
