"""Dictionary encoding: impression rows to counted binary examples.

An example row is `(keys.., pos, neg, idx ARRAY<INT>)`: `pos` positive and `neg` negative samples
that share the active dimensions `idx`. `idx` is sorted, starts with the bias 0 and keeps
duplicates, which act as a value of 2, 3, ...
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from clicktide.operators.sketch import BITS_PER_ENTRY, Bloom, bloom_filter
from clicktide.session import Written, materialise

# Dictionaries up to this many entries (12 bytes each) travel to every task as two arrays.
BROADCAST_MAX_ENTRIES = 5_000_000
# So many frequent features form the head of a larger dictionary.
HEAD_DIMS = 1_000_000

REPEATED = "the dictionary has repeated feature ids, see last_wins"


def combine_segments(impressions: DataFrame) -> DataFrame:
    """Adds `fids`: a slot's own features followed by the shared ones of its request.

    NULL ids, and NULL lists, are no features.
    """
    none = F.array().cast("array<bigint>")
    both = F.concat(F.coalesce("feats", none), F.coalesce("common", none))
    return impressions.withColumn("fids", F.filter(both, lambda f: f.isNotNull()))


def sample_counts(show: Column, click: Column) -> tuple[Column, Column]:
    """(`pos`, `neg`) of `show` samples of which the first `click` are positive.

    Clicks above the shows make all samples positive, negative clicks none. A negative number of
    shows fails the job.
    """
    checked = F.when(
        show < 0, F.raise_error(F.lit("negative number of shows")).cast("bigint")
    ).otherwise(show.cast("bigint"))
    pos = F.greatest(F.lit(0).cast("bigint"), F.least(click.cast("bigint"), checked))
    return pos, checked - pos


def fits_broadcast(dictionary: DataFrame, max_entries: int = BROADCAST_MAX_ENTRIES) -> bool:
    """True if the dictionary has at most `max_entries` rows; looks no further than needed."""
    return dictionary.limit(max_entries + 1).count() <= max_entries


def check_unique(dictionary: DataFrame) -> None:
    """Fails if a feature id has several dims; `last_wins` makes a dictionary unique."""
    if not dictionary.groupBy("fid").count().filter("count > 1").isEmpty():
        raise ValueError(REPEATED)


def encode(
    impressions: DataFrame,
    dictionary: DataFrame,
    keys: Sequence[str] = ("req", "seg"),
    method: str = "auto",
    max_entries: int = BROADCAST_MAX_ENTRIES,
    head_dims: int = HEAD_DIMS,
    bloom_bits: int = BITS_PER_ENTRY,
) -> DataFrame:
    """Counted examples. Features missing in `dictionary(fid, dim)` are dropped; a row without
    any known feature stays as a bias-only example.

    `broadcast` looks features up in place: no shuffle. `join` does so for the `head_dims` most
    frequent features and joins the rest by id; it works for any dictionary size. `auto` counts the
    dictionary against `max_entries` to choose. All give the same rows: one for each impression, so
    `keys` are carried along and may be NULL or repeat. A repeated feature id fails the job.

    In the `join` form a Bloom filter of the other entries, of `bloom_bits` bits for each, drops unknown
    ids where they are read, so that they are not shuffled; 0 leaves it out.
    """
    if method not in ("auto", "broadcast", "join"):
        raise ValueError("method must be 'auto', 'broadcast' or 'join'")
    pos, neg = sample_counts(F.col("show"), F.col("click"))
    rows = combine_segments(impressions).select(
        *keys, pos.alias("pos"), neg.alias("neg"), "fids"
    )
    if method != "join":
        # One job tells whether the dictionary fits, and fetches it if so.
        table = dictionary.select("fid", "dim").limit(max_entries + 1).toArrow()
        if table.num_rows <= max_entries:
            return _looked_up(rows, _sorted_entries(table)).drop("_rest")
        if method == "broadcast":
            raise ValueError(f"dictionary has more than {max_entries} entries, use method='join'")
    check_unique(dictionary)
    return _encode_join(rows, dictionary, head_dims, bloom_bits)


def most_frequent(rows: DataFrame, dictionary: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """`dictionary` as (at most `most` frequent entries, the others).

    Counts `n` of the dictionary tell what is frequent, else one pass over the features of `rows`.
    """
    entries = dictionary.select("fid", "dim", *(["n"] if "n" in dictionary.columns else []))
    if "n" not in entries.columns:
        seen = rows.select(F.explode("fids").alias("_fid")).groupBy("_fid").agg(F.count("*").alias("n"))
        joined = entries.join(seen, F.col("fid") == F.col("_fid"), "left")
        entries = materialise(joined.select("fid", "dim", F.coalesce("n", F.lit(0)).alias("n")))
    size = entries.count()
    if size <= most:
        return entries, entries.limit(0)
    # The cut is exact where counts differ; entries that tie with it stay outside the head.
    cut = entries.approxQuantile("n", [1 - most / size], 0.1 * most / size)[0]
    head = F.col("n") > cut
    if not fits_broadcast(entries.filter(head), 2 * most):
        head = F.lit(False)
    return entries.filter(head), entries.filter(~head)


def _encode_join(rows: DataFrame, dictionary: DataFrame, head_dims: int, bloom_bits: int) -> DataFrame:
    # Frequent features are looked up in place, and rows are written once, each under a number. Only rows
    # that have a feature left over, which may be in the tail, and those features are shuffled.
    head, tail = most_frequent(rows, dictionary, head_dims)
    known = _sorted_entries(head.select("fid", "dim").toArrow())
    entries = tail.count() if bloom_bits else 0
    if bloom_bits and not entries:
        return _looked_up(rows, known).drop("_rest")
    rest = bloom_filter(tail, entries, bloom_bits) if bloom_bits else None
    near = Written(_looked_up(rows, known, rest).withColumn("_row", F.monotonically_increasing_id())).rows
    done = near.filter(F.size("_rest") == 0).drop("_rest", "_row")
    left = near.filter(F.size("_rest") > 0)
    far = (
        left.select("_row", F.explode("_rest").alias("fid"))
        .join(tail.select("fid", "dim"), "fid")
        .groupBy("_row")
        .agg(F.collect_list("dim").alias("_more"))
        .withColumnRenamed("_row", "_at")
    )
    more = F.coalesce("_more", F.array().cast("array<int>"))
    both = left.join(far, F.col("_row") == F.col("_at"), "left")
    return done.unionByName(
        both.withColumn("idx", F.array_sort(F.concat("idx", more))).select(*done.columns)
    )


def _sorted_entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, dims) by id."""
    table = table.sort_by("fid")
    fids = table.column("fid").to_numpy().astype(np.int64)
    if (fids[1:] == fids[:-1]).any():
        raise ValueError(REPEATED)
    return fids, table.column("dim").to_numpy().astype(np.int32)


def _looked_up(
    rows: DataFrame, entries: tuple[np.ndarray, np.ndarray], others: Bloom | None = None
) -> DataFrame:
    """`rows` with `idx` for `fids`, and `_rest`, the features that are not in `entries` and may be
    in `others`, as often as a row has them."""
    shared = rows.sparkSession.sparkContext.broadcast((*entries, others))
    carried = [f for f in rows.schema.fields if f.name != "fids"]
    added = [
        T.StructField("idx", T.ArrayType(T.IntegerType(), False)),
        T.StructField("_rest", T.ArrayType(T.LongType(), False)),
    ]
    schema = T.StructType([*carried, *added])
    names = [f.name for f in schema]

    def look_up_and_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, dim, maybe = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("fids"))
            idx, rest = _encode_lists(column, known, dim, maybe)
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in carried]
            yield pa.RecordBatch.from_arrays([*arrays, idx, rest], names)

    return rows.mapInArrow(look_up_and_filter, schema)


def _encode_lists(
    column: pa.ListArray, known: np.ndarray, dim: np.ndarray, others: Bloom | None
) -> tuple[pa.ListArray, pa.ListArray]:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("NULL feature ids must be dropped before")
    values = flat.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    if len(known):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        hit = known[at] == values
        dims = dim[at[hit]]
    else:
        hit, dims = np.zeros(len(values), bool), np.empty(0, np.int32)
    open_row, rest = row[~hit], values[~hit]
    if others is not None:
        maybe = others.may_hold(rest)
        open_row, rest = open_row[maybe], rest[maybe]
    row = row[hit]
    # The bias joins as dim 0, so one sort by (row, dim) puts it first in every row.
    row = np.concatenate([row, np.arange(len(lengths), dtype=np.int64)])
    dims = np.concatenate([dims, np.zeros(len(lengths), np.int32)])
    key = np.sort((row << 32) | dims)
    lists = _in_rows(key >> 32, (key & 0xFFFFFFFF).astype(np.int32), len(lengths))
    return lists, _in_rows(open_row, rest.astype(np.int64), len(lengths))


def _in_rows(row: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """A list column of `n` rows; `row` ascends."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
