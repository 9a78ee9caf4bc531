"""Near-duplicate vectors: spherical k-means cells, blocked cosines inside them, components."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clicktide.llm.components import components
from clicktide.llm.storage import stored

COSINE = 0.93
# Different vectors of a label that one cell shall hold.
CELL_ROWS = 4096
MOST_CELLS = 4096
# Centres are fitted on at most so many vectors, chosen by hash.
FIT_ROWS = 20_000
FIT_ROUNDS = 8
BLOCK_ROWS = 256
# Entries of the largest table of vectors by centres that is made at once: 16 MB.
TABLE_ENTRIES = 1 << 21
# Rows that `assigned` hands on at once.
OUT_ROWS = 2048


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS, seed: int = 1) -> np.ndarray:
    """`k` unit centres of the unit vectors `x`; an empty cell keeps its centre."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    step = max(1, TABLE_ENTRIES // k)
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + step] @ centres.T).argmax(axis=1) for i in range(0, len(x), step)])
        order = np.argsort(home, kind="stable")
        cells, first = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        good = norms[:, 0] > 1e-12
        centres[cells[good]] = sums[good] / norms[good]
    return centres


def _valid() -> Column:
    """Whether a vector can link: a label, finite components only, not zero."""
    value = F.col("embedding")
    finite = F.forall(
        value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    ) & F.exists(value, lambda v: v != 0)
    return F.coalesce(F.col("label").isNotNull() & value.isNotNull() & finite, F.lit(False))


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit vectors, one in each row, from a list column whose lists have equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    # The largest component first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(reps: DataFrame) -> np.ndarray | None:
    """Centres for the most frequent dimension, or None if one cell for each label will do."""
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "dim").limit(1).collect()
    if not top:
        return None
    k = min(MOST_CELLS, ceil(top[0].n / CELL_ROWS))
    if k == 1:
        return None
    sample = (
        reps.filter(F.col("dim") == top[0].dim).select("uid", "embedding")
        .orderBy(F.xxhash64("uid"), "uid").limit(FIT_ROWS).toArrow()
    )
    x = _vectors(sample.column("embedding").combine_chunks())
    return spherical_kmeans(x, min(k, len(x)))


def assigned(reps: DataFrame, centres: np.ndarray | None, cosine: float = COSINE) -> DataFrame:
    """`reps` by `(cell, home)`: each in its home cell, and in each cell it may have a partner in.

    A vector x in cell c has x.c >= x.c'. For a partner y of x with home c' this is possible only
    if y.(c' - c) <= sin(angle) |c' - c|, since x is at most the angle away. So y is put into c as
    well if that holds, and a home vector finds all its partners in its own cell.
    """
    reach = float(np.sqrt(1 - cosine**2)) + 1e-9
    names = reps.columns
    at = names.index("embedding")

    step = max(1, TABLE_ENTRIES // len(centres)) if centres is not None else 1

    def cells_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether it is the row's home) of unit vectors."""
        near = x @ centres.T
        best = near.argmax(axis=1)
        # Distances of unit centres, from above.
        width = np.sqrt(np.maximum(0, 2 - 2 * (centres[best] @ centres.T))) + 1e-7
        gap = near[np.arange(len(x)), best][:, None] - near
        i, c = np.nonzero((gap <= reach * width) | (np.arange(len(centres)) == best[:, None]))
        return i, c, c == best[i]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            n = len(column)
            fits = np.zeros(n, bool)
            if centres is not None and n:
                fits = np.diff(np.asarray(column.offsets)) == centres.shape[1]
            rest, own = np.flatnonzero(~fits), np.flatnonzero(fits)
            yield from entered(batch, rest, np.zeros(len(rest), np.int64), np.ones(len(rest), bool))
            for start in range(0, len(own), step):
                some = own[start : start + step]
                i, c, home = cells_of(_vectors(column.take(pa.array(some))))
                yield from entered(batch, some[i], c, home)

    def entered(batch: pa.RecordBatch, row, cell, home) -> Iterator[pa.RecordBatch]:
        # A vector may enter many cells, so its copies leave in small batches.
        for start in range(0, len(row), OUT_ROWS):
            part = slice(start, start + OUT_ROWS)
            columns = batch.take(pa.array(row[part])).columns
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(cell[part]), pa.array(home[part])], [*names, "cell", "home"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reps.schema)
    return reps.mapInArrow(assign, f"{fields}, cell long, home boolean")


def _local_labels(near: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Least id that each row and column of a link matrix reaches inside it."""
    top = np.iinfo(np.int64).max
    while True:
        up = np.minimum(left, np.where(near, right[None, :], top).min(axis=1, initial=top))
        across = np.minimum(right, np.where(near, up[:, None], top).min(axis=0, initial=top))
        if (up == left).all() and (across == right).all():
            return left, right
        left, right = up, across


def _compare(cosine: float):
    """Pairs of blocks to `(uid, n, reached)`: links of home vectors, and edges between vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                uid_a, vec_a, uid_b, vec_b, n_b = (batch.column(k)[i] for k in range(5))
                uid_a, uid_b = (u.values.to_numpy() for u in (uid_a, uid_b))
                weight = n_b.values.to_numpy()
                near = _vectors(vec_a.values) @ _vectors(vec_b.values).T >= cosine
                same = uid_a[:, None] == uid_b[None, :]
                near |= same
                # A vector's other copies link with it, it does not link with itself.
                links = near @ weight - same.sum(axis=1)
                some, other = np.flatnonzero(near.sum(axis=1) > same.sum(axis=1)), near.any(axis=0)
                lab_a, lab_b = _local_labels(near[some][:, other], uid_a[some], uid_b[other])
                uid = np.concatenate([uid_a, uid_a[some], uid_b[other]])
                n = np.concatenate([links, np.zeros(len(some) + other.sum(), np.int64)])
                reached = np.concatenate([uid_a, lab_a, lab_b])
                keep = (n > 0) | (uid != reached)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[keep]) for c in (uid, n, reached)], ["uid", "n", "reached"]
                )

    return run


def links(reps: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`(uid, n, reached)` of `reps` (uid, n_rows, label, dim, embedding): partial counts and edges.

    Cells are dealt into blocks of about `block_rows` vectors; each block of home vectors meets all
    blocks of its cell, and only sums and one edge for each vector leave a meeting.
    """
    cells = assigned(reps, fit_centres(reps), cosine)
    cells = stored(cells)
    key = ["label", "dim", "cell"]
    size = cells.groupBy(*key).agg(F.count("*").alias("n_cell"))
    named = size.select(*(F.col(c).alias(f"_{c}") for c in key), F.ceil(F.col("n_cell") / block_rows).alias("n_blocks"))
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    dealt = cells.join(named, same).withColumn("block", F.pmod(F.xxhash64("uid"), "n_blocks"))
    rows = F.collect_list(F.struct("uid", "embedding", "n_rows")).alias("x")
    alls = dealt.groupBy(*key, "block").agg(rows)
    home = dealt.filter("home").groupBy(*key, "block").agg(rows)
    alls = stored(alls).select(
        *(F.col(c).alias(f"_{c}") for c in key),
        F.col("x.uid").alias("uid_b"), F.col("x.embedding").alias("vec_b"), F.col("x.n_rows").alias("n_b"),
    )
    home = home.select(*key, F.col("x.uid").alias("uid_a"), F.col("x.embedding").alias("vec_a"))
    meet = home.join(alls, same).select("uid_a", "vec_a", "uid_b", "vec_b", "n_b")
    return meet.mapInArrow(_compare(cosine), "uid long, n long, reached long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """`(vec_id, n_links, component_id, kept)` for each row of `vectors` (vec_id, embedding, label).

    Rows are linked if their labels are equal and their cosine, in double precision, is at least
    `cosine`. Equal vectors of a label are compared once and count by their number. Vectors of
    different length link with nothing of the other length; null, zero and not finite vectors and
    those without a label link with nothing and are kept. Rows may repeat (they link with each other);
    a null vec_id is never the smallest of a component unless nothing else is, and is not kept.
    An empty table gives an empty table; more columns are ignored.
    """
    rows = vectors.select("vec_id", "embedding", "label").withColumn("_valid", _valid())
    # Two hashes name a vector, so that equal ones meet without carrying their components.
    names = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64("embedding", F.lit(1), "label").alias("h2")]
    good = rows.filter("_valid").select("vec_id", "embedding", "label", *names)
    reps = good.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n_rows"),
        F.first("embedding").alias("embedding"), F.first("label").alias("label"),
    )
    reps = stored(reps.withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    found = stored(links(reps.select("uid", "n_rows", "label", "dim", "embedding"), cosine))
    counts = found.groupBy("uid").agg(F.sum("n").alias("n")).select(F.col("uid").alias("_uid"), "n")
    edges = found.filter("uid <> reached").select(F.col("uid").alias("a"), F.col("reached").alias("b"))
    comps = components(edges).withColumnRenamed("node", "_node")
    marked = (
        reps.select("uid", "h1", "h2", "least", "n_rows")
        .join(counts, F.col("uid") == F.col("_uid"), "left")
        .join(comps, F.col("uid") == F.col("_node"), "left")
        .select("h1", "h2", "least", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "uid").alias("component"))
    )
    marked = stored(marked)
    least = marked.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = marked.join(least, "component").select(
        F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "n_links", "component_id"
    )
    linked = good.select("vec_id", "h1", "h2").join(
        classes, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    ).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("_valid")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


OP1_SQL = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), g AS (
  SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_inner_product(e, e) > 0
), l AS (
  SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}
), reach(r, seen) AS (
  SELECT r, r FROM v UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.seen
), c AS (
  SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.seen GROUP BY reach.r
)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.r) AS n_links, component_id,
       coalesce(vec_id = component_id, FALSE) AS kept
FROM v JOIN c USING (r)"""


def op1_embeddings(spark, sf: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet"))
