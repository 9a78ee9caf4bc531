"""Ranked lexical search over an index of segments whose documents are ordered by length stratum.

A segment holds the postings of some megabytes of whole documents, so that building it shuffles
nothing and searching it needs no other segment. Its documents are numbered by (m, doc_id), m being
the normaliser that the ranking derives from a document's length: a stratum, all documents of equal
m, is a range of numbers. The postings of a term are ordered by stratum, then by tf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from clicktide.llm.storage import numbered, stored
from clicktide.llm.text import NOT_ALNUM, Slice, measured, slices
from clicktide.session import ensure_checkpoint_dir

TOP = 20
# A segment ends after so many bytes of text, or so many documents (their numbers take 16 bits).
SEGMENT_BYTES, SEGMENT_DOCS = 8 << 20, 1 << 16
# Pairs (item, term) that travel to every task at once; more items are searched in blocks.
BLOCK_PAIRS = 200_000
# Documents whose strata are visited at first; each visit is twice as large as the one before.
FIRST_VISIT = 256

# The ranking's fixed values.
WEIGHT_SCALE, IMPACT_SCALE = 1000, 1_000_000_000
NORM_BASE, NORM_SHARE, TF_SCALE, NORM_SCALE = 100, 25, 1000, 12


def normaliser(n: int, n_docs: int, n_terms: int) -> int:
    """m of a document with `n` terms among `n_docs` documents with `n_terms` terms."""
    return NORM_BASE - NORM_SHARE + (NORM_SHARE * n * n_docs) // n_terms


def term_weight(df: int, n_docs: int) -> int:
    """w of a term that `df` of `n_docs` documents hold."""
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one occurrence of a term in an item adds to a score, by weight."""
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + NORM_SCALE * m)


@dataclass
class Index:
    """`rows (segment, term, docs, tfs, ids)`: postings, and under the term "" the documents' ids
    and m (in `tfs`); the number of documents with a term, of terms, and of segments."""

    rows: DataFrame
    n_docs: int
    n_terms: int
    segments: int


# --- building -----------------------------------------------------------------------------


class _Segment:
    """Words of some whole documents, gathered slice by slice."""

    def __init__(self):
        self.bytes, self.docs = 0, 0
        self._raw, self._hashes, self._doc, self._starts, self._ends, self._n = [], [], [], [], [], []

    def add(self, part: Slice) -> None:
        self._raw.append(part.raw)
        self._hashes.append(part.word_hashes())
        self._doc.append(part.doc + self.docs)
        self._starts.append(part.starts + self.bytes)
        self._ends.append(part.ends + self.bytes)
        self._n.append(np.diff(part.word_bounds))
        self.bytes += len(part.raw)
        self.docs += part.n

    def lengths(self) -> np.ndarray:
        return np.concatenate(self._n) if self._n else np.zeros(0, np.int64)

    def postings(self, number: np.ndarray):
        """(terms, first posting of each and the end, document numbers, tfs), by term and number."""
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        hashes = join(self._hashes, np.uint64)
        _, first, term = np.unique(hashes, return_index=True, return_inverse=True)
        docs = max(len(number), 1)
        key, tf = np.unique(term * docs + number[join(self._doc, np.int64)], return_counts=True)
        term, doc = key // docs, key % docs
        starts, ends = join(self._starts, np.int64)[first], join(self._ends, np.int64)[first]
        raw = join(self._raw, np.uint8)
        return _cut(raw, starts, ends), np.searchsorted(term, np.arange(len(first) + 1)), doc, tf


def _cut(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings between `starts` and `ends` of UTF-8 bytes."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = raw[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.string(), len(sizes), buffers)


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = (bounds * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


_ROWS = "segment LONG, term STRING, docs BINARY, tfs BINARY, ids ARRAY<LONG>"
_NAMES = ["segment", "term", "docs", "tfs", "ids"]


def _segment_rows(segment: _Segment, ids: pa.Array, number: int, n_docs: int, n_terms: int):
    lengths, at = np.unique(segment.lengths(), return_inverse=True)
    m = np.array([normaliser(int(n), n_docs, n_terms) for n in lengths], np.int64)[at]
    known = np.asarray(ids.is_valid())
    order = np.lexsort((ids.fill_null(0).to_numpy(), ~known, m))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    m = m[order]
    terms, bounds, doc, tf = segment.postings(place)
    stratum = np.searchsorted(np.unique(m), m)
    of_term = np.repeat(np.arange(len(terms)), np.diff(bounds))
    by_tf = np.lexsort((tf, stratum[doc], of_term))
    kind = pa.list_(pa.int64())
    own = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids.take(pa.array(order)).cast(pa.int64()))
    head = [pa.array([number]), pa.array([""]), pa.array([b""]), pa.array([m.tobytes()]), own]
    yield pa.RecordBatch.from_arrays(head, _NAMES)
    arrays = [
        pa.array(np.full(len(terms), number)), terms,
        _binaries(doc[by_tf].astype(np.uint16), bounds), _binaries(tf[by_tf].astype(np.int32), bounds),
        pa.nulls(len(terms), kind),
    ]
    whole = pa.RecordBatch.from_arrays(arrays, _NAMES)
    for start in range(0, len(terms), 4096):
        yield whole.slice(start, 4096)


def _count(part: Slice) -> list:
    return [np.diff(part.word_bounds)]


def build(docs: DataFrame, id: str = "doc_id", text: str = "text") -> Index:
    """The index of every row of `docs`, written to the shared checkpoint folder.

    One pass counts documents and terms, a second writes postings; nothing is shuffled. Terms are
    the runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased.
    Null and empty texts hold no terms; their documents are listed and never found. Rows may repeat,
    `id` (integer) may be null, texts may be longer than a segment. Other columns are ignored.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    counted = measured(rows.select("text"), [("n", "long")], _count, separator=NOT_ALNUM, lower=True, drop=("text",))
    n_docs, n_terms = counted.agg(
        F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))
    ).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers are per task and count its segments.
        number = TaskContext.get().partitionId() << 32
        segment, ids = _Segment(), []

        def finish():
            return _segment_rows(segment, pa.concat_arrays(ids), number, n_docs, max(n_terms, 1))

        for batch in batches:
            for part in slices(batch.column(1), NOT_ALNUM, True):
                for piece, first in _pieces(part):
                    if segment.docs and (
                        segment.bytes + len(piece.raw) > SEGMENT_BYTES or segment.docs + piece.n > SEGMENT_DOCS
                    ):
                        yield from finish()
                        segment, ids, number = _Segment(), [], number + 1
                    segment.add(piece)
                    ids.append(batch.column(0).slice(first, piece.n))
        if segment.docs:
            yield from finish()

    written = stored(rows.mapInArrow(run, _ROWS))
    return Index(written, n_docs, n_terms, written.filter("term = ''").count())


def _pieces(part: Slice) -> Iterator[tuple[Slice, int]]:
    """A slice, in parts of no more documents than a segment may have, with the first row of each."""
    if part.n <= SEGMENT_DOCS:
        yield part, part.first
        return
    for a in range(0, part.n, SEGMENT_DOCS):
        b = min(part.n, a + SEGMENT_DOCS)
        lo, hi = part.bounds[a], part.bounds[b]
        yield Slice(a, part.raw[lo:hi], part.bounds[a : b + 1] - lo, NOT_ALNUM), part.first + a


# --- searching ----------------------------------------------------------------------------


@dataclass
class _Items:
    """Items of a block: for each its place in `terms` and the weight, repeats included, of each term."""

    terms: dict[str, int]
    numbers: list[int]
    of: list[np.ndarray]
    weights: list[np.ndarray]


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """`(_item, _term, _times)` of `items (_item, text)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), NOT_ALNUM, True):
                segment = _Segment()
                segment.add(part)
                terms, bounds, doc, tf = segment.postings(np.arange(part.n))
                of_term = np.repeat(np.arange(len(terms)), np.diff(bounds))
                item = batch.column(0).slice(part.first, part.n).take(pa.array(doc))
                arrays = [item, terms.take(pa.array(of_term)), pa.array(tf)]
                yield pa.RecordBatch.from_arrays(arrays, ["_item", "_term", "_times"])

    return items.select("_item", text).mapInArrow(run, "_item LONG, _term STRING, _times LONG")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each range, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class _Opened:
    """A segment's postings of some terms, cut into runs of one stratum."""

    def __init__(self, table: pa.Table, terms: dict[str, int]):
        table = table.combine_chunks()
        names = table.column("term").to_pylist()
        head = names.index("")
        self.ids = table.column("ids")[head].values
        m = np.frombuffer(table.column("tfs")[head].as_buffer(), np.int64)
        self.m, first = np.unique(m, return_index=True)
        # Documents of stratum s are numbered bounds[s] to bounds[s + 1].
        self.bounds = np.append(first, len(m))
        rows = [i for i, name in enumerate(names) if i != head and name in terms]
        read = lambda name, kind: [np.frombuffer(table.column(name)[i].as_buffer(), kind) for i in rows]
        docs, tfs = read("docs", np.uint16), read("tfs", np.int32)
        none = [np.zeros(0, np.int64)]
        self.doc = np.concatenate(none + docs).astype(np.int64)
        tf = np.concatenate(none + tfs).astype(np.int64)
        term = np.repeat(np.array([terms[names[i]] for i in rows], np.int64), [len(d) for d in docs])
        stratum = np.searchsorted(self.bounds, self.doc, "right") - 1
        self.impact = impacts(tf, self.m[stratum]) if len(tf) else tf
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1])
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(term)))
        self.stratum = stratum[self.start]
        # Postings of a stratum are ordered by tf, so the last one has the greatest impact.
        self.best = self.impact[self.start + self.size - 1] if len(term) else self.impact
        run_term = term[self.start]
        by_term = np.flatnonzero(np.append(True, run_term[1:] != run_term[:-1])) if len(run_term) else self.start
        self.runs = dict(zip(run_term[by_term].tolist(), zip(by_term.tolist(), np.append(by_term[1:], len(run_term)).tolist())))


def best_of(opened: _Opened, of: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of an item's `k` best in a segment.

    The bound of a stratum is the sum of its terms' greatest impacts. Strata are visited from the
    highest bound on, until the next one cannot reach the k-th score found.
    """
    mine = [(opened.runs[t], w) for t, w in zip(of.tolist(), weights.tolist()) if t in opened.runs]
    empty = np.zeros(0, np.int64)
    if not mine:
        return empty, empty
    run = np.concatenate([np.arange(a, b) for (a, b), _ in mine])
    weight = np.repeat([w for _, w in mine], [b - a for (a, b), _ in mine])
    bound = np.zeros(len(opened.m), np.int64)
    np.add.at(bound, opened.stratum[run], weight * opened.best[run])
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    sizes = np.cumsum(np.diff(opened.bounds)[order])
    # Runs by the place of their stratum in the visits.
    turn = np.full(len(opened.m), len(order))
    turn[order] = np.arange(len(order))
    by_turn = np.argsort(turn[opened.stratum[run]], kind="stable")
    run, weight = run[by_turn], weight[by_turn]
    turns = turn[opened.stratum[run]]
    scores = np.zeros(len(opened.ids), np.int64)
    done, most, found, values = 0, FIRST_VISIT, empty, empty
    while done < len(order):
        if len(found) == k and bound[order[done]] < values.min():
            break
        seen = sizes[done - 1] if done else 0
        after = max(done + 1, int(np.searchsorted(sizes, seen + most, "right")))
        a, b = np.searchsorted(turns, [done, after])
        chosen, n = run[a:b], opened.size[run[a:b]]
        at = _ranges(opened.start[chosen], n)
        docs = opened.doc[at]
        np.add.at(scores, docs, opened.impact[at] * np.repeat(weight[a:b], n))
        fresh = np.unique(docs)
        fresh = fresh[scores[fresh] > 0]
        found, values = np.append(found, fresh), np.append(values, scores[fresh])
        if len(found) > k:
            ids = opened.ids.take(pa.array(found))
            first = np.lexsort((ids.fill_null(0).to_numpy(), ~np.asarray(ids.is_valid()), -values))[:k]
            found, values = found[first], values[first]
        done, most = after, 2 * most
    return found, values


def _found_in(index: Index, block: _Items, k: int) -> DataFrame:
    """`(_item, doc_id, score, segment)`: the best of each segment for each item of a block."""
    spark = index.rows.sparkSession
    shared = spark.sparkContext.broadcast(block)
    wanted = F.broadcast(_table(spark, [("", 0), *block.terms.items()], "_wanted STRING, _number LONG"))
    rows = index.rows.join(wanted, F.col("term") == F.col("_wanted")).select(*_NAMES)

    def rank(table: pa.Table) -> pa.Table:
        items = shared.value
        opened = _Opened(table, items.terms)
        out = [best_of(opened, of, w, k) for of, w in zip(items.of, items.weights)]
        docs = np.concatenate([d for d, _ in out])
        arrays = [
            pa.array(np.repeat(np.array(items.numbers, np.int64), [len(d) for d, _ in out])),
            opened.ids.take(pa.array(docs)),
            pa.array(np.concatenate([s for _, s in out])),
            pa.array(np.full(len(docs), table.column("segment")[0].as_py())),
        ]
        return pa.Table.from_arrays(arrays, ["_item", "doc_id", "score", "segment"])

    return rows.groupBy("segment").applyInArrow(rank, "_item LONG, doc_id LONG, score LONG, segment LONG")


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    columns = list(zip(*rows)) if rows else [[] for _ in schema.split(", ")]
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, columns)))), schema)


def search(
    index: Index, items: DataFrame, k: int = TOP, id: str = "item_id", text: str = "text",
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """`(id, rank, doc_id, score)`: the `k` best documents with a score above 0 for each row of `items`.

    Ranks go by falling score, equal scores by rising doc_id, null last. Items are searched in blocks
    of about `block_pairs` pairs of item and term; a segment sends its own `k` best, of which
    groups of segments and then all keep the best. Items without a known term have no rows.
    Items may repeat or have a null id: each row is searched by itself. No items, or an empty index,
    give an empty table. Other columns are ignored.
    """
    spark = items.sparkSession
    ensure_checkpoint_dir(spark)
    named = items.select(F.col(id).alias("_id"), F.col(text).alias("text"))
    named = stored(named.withColumn("_item", F.monotonically_increasing_id()))
    pairs = numbered(item_terms(named), [F.col("_item"), F.col("_term")], "_place")
    first = pairs.groupBy("_item").agg(F.min("_place").alias("_first")).withColumnRenamed("_item", "_of")
    block = F.floor(F.col("_first") / block_pairs)
    pairs = stored(pairs.join(first, F.col("_item") == F.col("_of")).select("_item", "_term", "_times", block.alias("_block")))
    blocks = (pairs.agg(F.max("_block")).first()[0] or 0) + 1
    parts = []
    for b in range(blocks):
        mine = pairs.filter(F.col("_block") == b).select("_item", "_term", "_times")
        table = mine.orderBy("_item", "_term").toArrow()
        terms = sorted(set(table.column("_term").to_pylist()))
        if not terms:
            continue
        wanted = F.broadcast(_table(spark, [(t, 0) for t in terms], "_wanted STRING, _number LONG"))
        df = dict(
            index.rows.join(wanted, F.col("term") == F.col("_wanted"))
            .groupBy("term").agg(F.sum(F.octet_length("docs") / 2).cast("long").alias("df")).collect()
        )
        weight = {t: term_weight(n, index.n_docs) for t, n in df.items()}
        place = {t: i for i, t in enumerate(sorted(weight))}
        ready = _Items(place, [], [], [])
        item = table.column("_item").to_numpy()
        times, names = table.column("_times").to_numpy(), table.column("_term").to_pylist()
        cuts = np.append(np.flatnonzero(np.append(True, item[1:] != item[:-1])), len(item))
        for a, z in zip(cuts[:-1], cuts[1:]):
            known = [j for j in range(a, z) if names[j] in place]
            if known:
                ready.numbers.append(int(item[a]))
                ready.of.append(np.array([place[names[j]] for j in known]))
                ready.weights.append(np.array([weight[names[j]] * int(times[j]) for j in known], np.int64))
        if ready.numbers:
            parts.append(_found_in(index, ready, k))
    if not parts:
        found = spark.createDataFrame([], "_item LONG, doc_id LONG, score LONG, segment LONG")
    else:
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("segment"), F.lit(math.isqrt(index.segments) + 1))
    some = found.withColumn("_salt", salt)
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy("_item", "_salt").orderBy(*best)))
    some = some.filter(F.col("_n") <= k).select("_item", "doc_id", "score")
    rank = F.row_number().over(Window.partitionBy("_item").orderBy(*best))
    ranked = some.withColumn("rank", rank).filter(F.col("rank") <= k)
    own = named.select(F.col("_item").alias("_own"), "_id")
    return ranked.join(own, F.col("_item") == F.col("_own")).select(F.col("_id").alias(id), "rank", "doc_id", "score")


def op11_search(spark, sf: str) -> DataFrame:
    index = build(spark.read.parquet(f"{sf}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf}/benchmark.parquet"))


def _sql_terms(table: str, key: str) -> str:
    return f"""SELECT row_number() OVER () AS r, {key}, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS l FROM {table}"""


OP11_SQL = f"""
WITH d AS ({_sql_terms('documents', 'doc_id')}),
q AS ({_sql_terms('benchmark', 'item_id')}),
c AS (SELECT CAST(count(*) FILTER (len(l) > 0) AS BIGINT) AS n_docs, CAST(sum(len(l)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(l) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor({WEIGHT_SCALE} * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
m AS (SELECT r, doc_id, {NORM_BASE - NORM_SHARE} + ({NORM_SHARE} * len(l) * n_docs) // n_terms AS m FROM d, c),
t AS (SELECT r AS i, item_id, term, count(*) AS times FROM (SELECT r, item_id, unnest(l) AS term FROM q) GROUP BY ALL),
s AS (SELECT i, item_id, p.r, any_value(doc_id) AS doc_id,
        CAST(sum(times * w * (({IMPACT_SCALE} * tf) // ({TF_SCALE} * tf + {NORM_SCALE} * m))) AS BIGINT) AS score
      FROM t JOIN w USING (term) JOIN p USING (term) JOIN m ON m.r = p.r GROUP BY i, item_id, p.r),
k AS (SELECT item_id, doc_id, score,
        CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}"""
