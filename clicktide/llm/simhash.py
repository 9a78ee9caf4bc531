"""SimHash near-duplicates: fingerprints of word shingles, linked at a small Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from clicktide.llm.components import components
from clicktide.llm.storage import stored
from clicktide.llm.text import Slice, measured, released

SHINGLE = 3
SEED = 42
BITS = 64
DISTANCE = 2
PARTS = (2, 3, 4)
# Buckets up to so many rows are compared in pairs, larger ones by shared neighbours.
PAIR_ROWS = 64
# Neighbours are up to half of this away, 2081 of them.
MOST_DISTANCE = 4


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text in lower case, as a signed 64-bit number."""
    words = text.split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        flat = b" ".join(words)
        spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        starts = [0, *(spaces + 1).tolist()]
        ends = [*spaces.tolist(), len(flat)][shingle - 1 :]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(flat[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends)
        )
    n = len(hashes)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """`docs` without `text`, with `fp`: the SimHash of the whole text.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are `shingle`
    consecutive words. Fewer words make one shingle, no word (or null) the fingerprint zero.
    """

    def measure(part: Slice) -> list:
        raw, at = part.raw.tobytes(), part.bounds.tolist()
        return [np.array([simhash(raw[a:b], shingle) for a, b in zip(at, at[1:])], np.int64)]

    return measured(docs, [("fp", "long")], measure, lower=True, drop=("text",))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, 64 x 64 counts of two bits set together) of all fingerprints."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bits = bits.astype(np.float64)
            total += bits.T @ bits
        i = np.arange(BITS * BITS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(total.ravel().astype(np.int64))], ["i", "n"]
        )

    # 4096 sums, however many rows there are.
    rows = fps.select("fp").mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
    both = np.zeros(BITS * BITS)
    for row in rows.collect():
        both[row.i] = row.n
    return fps.count(), both.reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits in `m` groups of about equal size; bits that vary together go into one group."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    cor = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(cor, 0)
    left, parts = list(range(BITS)), []
    for k in range(m, 0, -1):
        size = -(-len(left) // k)
        first = max(left, key=lambda b: (cor[b, left].sum(), -b))
        part = [first]
        left.remove(first)
        while len(part) < size:
            best = max(left, key=lambda b: (cor[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        parts.append(sorted(part))
    return parts


def _within(both: np.ndarray, n: int, part: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most 0, 1, .. `most` bits of `part`."""
    p = np.diag(both)[part] / max(n, 1)
    differ = 2 * p * (1 - p)
    chance = np.zeros(len(part) + 1)
    chance[0] = 1
    for d in differ:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return np.cumsum(chance)[: most + 1].tolist()


def allocate(n: int, both: np.ndarray, parts: list[list[int]], distance: int = DISTANCE):
    """(estimated rows handled, threshold per part): least cost with sum(threshold + 1) = distance + 1.

    Two fingerprints that differ in more than its threshold's bits in every part differ in more
    than `distance` bits. -1 leaves a part out. A part costs its probes and its candidate pairs.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        share = _within(both, n, part, distance)
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance - used + 1):
                probes = sum(comb(len(part), d) for d in range(t + 1))
                more = n * probes + n * n / 2 * share[t] if t >= 0 else 0.0
                now = (cost + more, [*chosen, t])
                if used + t + 1 not in step or now < step[used + t + 1]:
                    step[used + t + 1] = now
        best = step
    return best[distance + 1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _flips(bits: list[int], most: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for d in range(most + 1) for c in combinations(bits, d)]


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _probes(fps: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """`(part, key, fp, own)`: keys under which a fingerprint looks for others; `own` is its own."""
    def keys(k: int, part: list[int], t: int) -> Column:
        mask = _signed(sum(1 << b for b in part))
        own = F.col("fp").bitwiseAND(F.lit(mask).cast("long"))

        def key(flip: Column) -> Column:
            looked = own.bitwiseXOR(flip).alias("key")
            return F.struct(F.lit(k).alias("part"), looked, (flip == 0).alias("own"))

        return F.transform(_longs(_flips(part, t)), key)

    groups = [keys(k, p, t) for k, (p, t) in enumerate(zip(parts, thresholds)) if t >= 0]
    return fps.select("fp", F.explode(F.concat(*groups)).alias("e")).select(
        "e.part", "e.key", "fp", "e.own"
    )


def _verified(buckets: DataFrame, distance: int) -> DataFrame:
    """`(a, b)` from buckets `(fps, own)` of at most PAIR_ROWS rows each."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0)
            at = np.asarray(values.offsets, np.int64)
            fps = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
            own = np.asarray(batch.column(1).values.to_numpy(zero_copy_only=False), bool)
            size = np.diff(at)
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                for i in range(0, len(rows), max(1, (1 << 20) // int(n * n))):
                    take = at[rows[i : i + max(1, (1 << 20) // int(n * n))], None] + np.arange(n)
                    x, o = fps[take], own[take]
                    near = np.bitwise_count(x[:, :, None] ^ x[:, None, :]) <= distance
                    near &= (o[:, :, None] | o[:, None, :]) & (x[:, :, None] < x[:, None, :])
                    k, a, b = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[k, a].view(np.int64)), pa.array(x[k, b].view(np.int64))], ["a", "b"]
                    )

    return buckets.select("fps", "own").mapInArrow(released(compare), "a long, b long")


def links(fps: DataFrame, distance: int = DISTANCE, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Links `(a, b)` that join all fingerprints of `fps` (distinct `fp`) within `distance` bits.

    Generalised pigeonhole: correlated bits form parts, each part gets its own threshold by the
    cost of probes and of expected candidates, and only fingerprints that meet under a part's key
    are compared. Buckets of more than `pair_rows` rows are not compared in pairs: their members
    meet under all values up to `far` bits away from them, where `near` + `far` is `distance` and
    neither is more than half of it, rounded up. All that meet are chained to the least of those
    at most `near` away. Two values are at most `distance` bits apart exactly if they meet under one
    that is so near to one of them, hence this loses nothing and adds nothing. The number of
    neighbours bounds `distance` to MOST_DISTANCE; others raise a ValueError.
    """
    if not 0 <= distance <= MOST_DISTANCE:
        raise ValueError(f"distance must be from 0 to {MOST_DISTANCE}")
    n, both = bit_statistics(fps)
    plans = []
    for m in PARTS:
        parts = correlated_parts(n, both, m)
        plans.append((*allocate(n, both, parts, distance), parts))
    _, thresholds, parts = min(plans, key=lambda x: x[0])
    rows = _probes(fps, parts, thresholds)
    key = ["part", "key"]
    counts = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("own"), 1)).alias("n_own")
    )
    counts = counts.filter("n > 1 and n_own > 0").select(
        F.col("part").alias("_part"), F.col("key").alias("_key"), "n"
    )
    met = stored(
        rows.join(counts, (F.col("part") == F.col("_part")) & (F.col("key") == F.col("_key")))
        .select("part", "key", "fp", "own", "n")
    )
    pairs = _verified(
        met.filter(F.col("n") <= pair_rows).groupBy(*key).agg(
            F.collect_list(F.struct("fp", "own")).alias("x")
        ).select(F.col("x.fp").alias("fps"), F.col("x.own").alias("own")),
        distance,
    )
    near = distance // 2
    far, bits = distance - near, list(range(BITS))
    crowd = met.filter(F.col("n") > pair_rows).select("fp").distinct()
    # Flips come by number of bits, so the first ones are those of up to `near`.
    around = crowd.select("fp", F.posexplode(_longs(_flips(bits, far))).alias("flip", "bits")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("bits")).alias("hub"), (F.col("flip") < len(_flips(bits, near))).alias("own")
    )
    hubs = around.groupBy("hub").agg(F.min(F.when(F.col("own"), F.col("fp"))).alias("a"), F.count("*").alias("n"))
    hubs = hubs.filter("n > 1 and a is not null").select(F.col("hub").alias("_hub"), "a")
    chained = around.join(hubs, F.col("hub") == F.col("_hub")).filter("fp <> a")
    return pairs.unionAll(chained.select("a", F.col("fp").alias("b")))


def classes(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """`docs` without text, with `fp, component, component_id`: linked rows share `component`."""
    marked = stored(fingerprints(docs, shingle))
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = components(links(fps.select("fp"), distance))
    named = fps.join(comps.withColumnRenamed("node", "_fp"), F.col("fp") == F.col("_fp"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = stored(named)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "component").select(F.col("fp").alias("_fp"), "component", "component_id")
    return marked.join(labels, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """`(doc_id, fp, component_id)`: one row per row of `docs` (doc_id, text).

    Rows of equal fingerprint, and of fingerprints at most `distance` bits apart, are linked;
    `component_id` is the smallest doc_id that can be reached. Rows may repeat. Null and empty texts
    have fingerprint zero and are linked like others. A null doc_id gets a component as well, null
    only if no linked row has a doc_id. An empty table gives an empty table; columns other than
    doc_id and text are ignored.
    """
    rows = classes(docs.select("doc_id", "text"), shingle, distance)
    return rows.select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of `docs` for each class of near duplicates: that of the smallest doc_id.

    Of several texts with that doc_id the one with the smallest hash stays, of equal rows one. A row
    without doc_id stays only if its class has no doc_id. All columns are kept.
    """
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    rows = stored(classes(slim, shingle, distance).select("doc_id", "_hash", "component"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash")
    first = rows.groupBy("component").agg(F.min(rank).alias("one"))
    kept = first.select(F.col("one.doc_id").alias("_id"), F.col("one._hash").alias("_h"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h"))
    found = docs.join(kept, same, "left_semi")
    again = rows.groupBy("doc_id", "_hash").agg(F.count("*").alias("n")).filter("n > 1").limit(1)
    if again.isEmpty():
        return found
    # Rows that repeat: one of each doc_id and text.
    return found.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).drop("_hash")


def op2_simhash(spark, sf: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.select("doc_id", text.alias("fingerprint"), "component_id")
