"""Removal of word sequences that occur more than once, within or across documents.

A window is `length` consecutive words. Streaming every document past a suffix automaton of all
others would take time in proportion to documents times shards, so shards are met in Spark:

1. In each window the least hash of its `GRAM`-word sequences is its anchor. Equal windows have
   equal anchors at equal places, so only windows whose anchor recurs can recur.
2. Neighbouring windows with one anchor form a passage. Equal passages are collapsed to one, with
   the number of their occurrences.
3. Different passages with equal anchors are dealt to shards by their anchor. Each shard builds the
   suffix automaton of its passages, with the number of occurrences of each state; the matching
   statistics give the longest sequence that ends at a word and occurs at least twice. Where it
   has `length` words or more, the window ending there is removed.
4. Anchors with more than `crowd` passages would not fit a shard. Their passages are taken apart by
   halves: a range of windows goes if the words that all its windows share occur once, it is done if
   the range as a whole occurs twice, and only else it is halved. Counts are by hash in Spark,
   partially summed before they are shuffled, and a passage has few open ranges at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clicktide.llm.storage import stored
from clicktide.llm.text import WORD_BASE, Slice, Spans, buffers, mix, released, slices

LENGTH = 35
GRAM = 12
CROWD = 512
SHARD_WORDS = 50_000


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each `width` consecutive values, the leftmost of equal ones."""
    at, done = np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        a, b = at[:-step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        done += step
    return at


def passages(part: Slice, length: int = LENGTH, gram: int = GRAM):
    """(document, first window, number of windows, anchor hash, passage hash, anchor's place in it)."""
    starts = part.windows(length)
    if not len(starts):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)]
    spans = Spans(part.word_hashes(), WORD_BASE)
    first = np.arange(len(part.doc) - gram + 1)
    grams = spans.hashes(first, first + gram)
    anchor = least_places(grams, length - gram + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(starts)))
    at, doc = starts[begin], part.doc[starts[begin]]
    whole = spans.hashes(at, at + n - 1 + length)
    return doc, at - part.word_bounds[doc], n, grams[anchor[begin]], whole, anchor[begin] - at


class SuffixAutomaton:
    """All sequences of some passages of words; each state knows how often its sequences occur."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.count = [-1], [0], [0]

    def add(self, words: list[int], times: int) -> list[int]:
        """The state of each prefix of `words`, which occur `times` times."""
        nexts, link, size, count = self.next, self.link, self.size, self.count
        last, states = 0, []
        for w in words:
            q = nexts[last].get(w)
            if q is not None and size[q] == size[last] + 1:
                now = q
            else:
                if q is not None:
                    now = self._split(last, w, q)
                else:
                    now = len(nexts)
                    nexts.append({})
                    link.append(0)
                    size.append(size[last] + 1)
                    count.append(0)
                    p = last
                    while p >= 0 and w not in nexts[p]:
                        nexts[p][w] = now
                        p = link[p]
                    if p >= 0:
                        q = nexts[p][w]
                        link[now] = q if size[q] == size[p] + 1 else self._split(p, w, q)
            count[now] += times
            states.append(now)
            last = now
        return states

    def _split(self, p: int, w: int, q: int) -> int:
        """State of the sequences of `q` that are at most one word longer than those of `p`."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.count.append(0)
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def repeated(self) -> list[int]:
        """By state, the length of its longest suffix that occurs at least twice."""
        order = np.argsort(self.size, kind="stable").tolist()
        for s in reversed(order[1:]):
            self.count[self.link[s]] += self.count[s]
        longest = [0] * len(self.size)
        for s in order[1:]:
            longest[s] = self.size[s] if self.count[s] > 1 else longest[self.link[s]]
        return longest


def repeated_windows(texts: list[bytes], times: list[int], length: int = LENGTH) -> list[int]:
    """For each passage a number whose bit i is set if its window i occurs twice or more in all."""
    automaton, ids = SuffixAutomaton(), {}
    states = [
        automaton.add([ids.setdefault(w, len(ids)) for w in text.split()], n)
        for text, n in zip(texts, times)
    ]
    longest = automaton.repeated()
    return [
        sum(1 << i for i, s in enumerate(ends[length - 1 :]) if longest[s] >= length) for ends in states
    ]


KEY = ["_k1", "_k2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Two hashes of doc_id and text name a document; rows that repeat share them."""
    return docs.withColumns(
        {"_k1": F.xxhash64("doc_id", "text"), "_k2": F.xxhash64("text", F.lit(1), "doc_id")}
    )


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for part in slices(batch.column(2)):
                doc, at, n, gram, whole, place = passages(part, length)
                doc = doc + part.first
                columns = [keys[0][doc], keys[1][doc], gram.view(np.int64), whole.view(np.int64)]
                columns += [x.astype(np.int32) for x in (at, n, place)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["_k1", "_k2", "gram", "whole", "at", "n", "place"]
                )

    rows = docs.select("_k1", "_k2", "text")
    return rows.mapInArrow(released(run), "_k1 long, _k2 long, gram long, whole long, at int, n int, place int")


def _excerpts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Text of the passages in `wanted` (_k1, _k2, places), from the documents that hold them."""
    w = wanted.select(F.col("_k1").alias("_j1"), F.col("_k2").alias("_j2"), "places")
    rows = docs.join(w, (F.col("_k1") == F.col("_j1")) & (F.col("_k2") == F.col("_j2")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = buffers(batch.column(0))
            places = batch.column(1)
            for i in range(batch.num_rows):
                words = raw[bounds[i] : bounds[i + 1]].tobytes().split()
                fields = places[i].values.flatten()
                at, n = (fields[k].to_numpy() for k in (2, 3))
                texts = [b" ".join(words[a : a + m - 1 + length]) for a, m in zip(at.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(fields[k] for k in (0, 1, 3, 4, 5, 6)), pa.array(texts, pa.binary())],
                    ["gram", "whole", "n", "place", "times", "crowded", "words"],
                )

    return rows.select("text", "places").mapInArrow(
        released(run), "gram long, whole long, n int, place int, times long, crowded boolean, words binary"
    )


def _by_automaton(excerpts: DataFrame, n_shards: int, length: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        bits = repeated_windows(table.column("words").to_pylist(), table.column("times").to_pylist(), length)
        return table.select(["gram", "whole"]).append_column("bits", pa.array(bits, pa.int64()))

    shard = F.pmod(F.xxhash64("gram"), F.lit(n_shards)).alias("shard")
    dealt = excerpts.select(shard, "gram", "whole", "times", "words")
    return dealt.groupBy("shard").applyInArrow(run, "gram long, whole long, bits long")


OPEN = "gram long, whole long, n int, place int, times long, words binary, low int, high int"


def _halved(open_ranges: DataFrame, length: int) -> DataFrame:
    """Halves of ranges of windows, with hashes of what their windows share and of all their words.

    A range `low .. high - 1` holds the windows that begin so many words before the anchor; `bits`
    are those that the passage has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(5)):
                rows = batch.slice(part.first, part.n)
                n, place, low, high = (
                    rows.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 6, 7)
                )
                words, anchor = part.word_hashes(), part.word_bounds[:-1] + place
                spans = [Spans(words, base) for base in (WORD_BASE, WORD_BASE + 2)]
                middle = (low + high) // 2
                for lo, hi in ((low, middle), (middle, high)):
                    least, most = np.maximum(lo, place - n + 1), np.minimum(hi - 1, place)
                    i = np.flatnonzero((lo < hi) & (least <= most))
                    a, lo_i, hi_i, least, most = anchor[i], lo[i], hi[i], least[i], most[i]
                    salt = mix((lo_i * 64 + hi_i).astype(np.uint64))
                    own = mix((least * 64 + most).astype(np.uint64) + np.uint64(1))
                    core = [x.hashes(a - lo_i, a - hi_i + 1 + length) ^ salt for x in spans]
                    range_ = [x.hashes(a - most, a - least + length) ^ salt ^ own for x in spans]
                    one = np.int64(1)
                    bits = (one << (place[i] - least + 1)) - (one << (place[i] - most))
                    new = [lo_i.astype(np.int32), hi_i.astype(np.int32), bits]
                    new += [x.view(np.int64) for x in (*core, *range_)]
                    kept = rows.select(range(6)).take(pa.array(i))
                    names = [*kept.schema.names, "low", "high", "bits", "c1", "c2", "r1", "r2"]
                    yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, new)], names)

    added = "bits long, c1 long, c2 long, r1 long, r2 long"
    return open_ranges.mapInArrow(released(run), f"{OPEN}, {added}")


def _by_halves(excerpts: DataFrame, length: int) -> list[DataFrame]:
    """`(gram, whole, bits)` for crowded anchors."""
    columns = ["gram", "whole", "n", "place", "times", "words"]
    left = excerpts.select(
        *columns, F.lit(0).alias("low"), F.lit(length - GRAM + 1).alias("high")
    )
    done = []
    while not left.isEmpty():
        halves = stored(_halved(left, length))
        counts = []
        for kind in ("c", "r"):
            keys = [F.col(f"{kind}{i}").alias(f"_{kind}{i}") for i in (1, 2)]
            seen = halves.groupBy(*keys).agg(F.sum("times").alias("_n"))
            counts.append(seen.filter("_n > 1").drop("_n"))
        met = [(F.col(f"{k}1") == F.col(f"_{k}1")) & (F.col(f"{k}2") == F.col(f"_{k}2")) for k in "cr"]
        shared = halves.join(stored(counts[0]), met[0])
        judged = stored(shared.join(stored(counts[1]), met[1], "left"))
        settled, still = judged.filter("_r1 is not null"), judged.filter("_r1 is null")
        done.append(settled.select("gram", "whole", "bits"))
        # One of each settled range goes along where an open one shares its words, to be counted.
        met_by = still.select(F.col("c1").alias("_d1"), F.col("c2").alias("_d2")).distinct()
        one = settled.groupBy("c1", "c2", "r1", "r2").agg(
            F.sum("times").alias("times"),
            F.first(F.struct(*(c for c in (*columns, "low", "high") if c != "times"))).alias("x"),
        )
        one = one.join(met_by, (F.col("c1") == F.col("_d1")) & (F.col("c2") == F.col("_d2")), "left_semi")
        left = still.select(*columns, "low", "high").unionByName(
            one.select("times", "x.*").select(*columns, "low", "high")
        )
    return done


def repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """`(_k1, _k2, spans)` of keyed `docs`: per document with repeats, its passages `(at, n, bits)`.

    Bit i of `bits` is set if the window that begins at word `at + i` occurs anywhere else.
    `length` must be from GRAM to GRAM + 60.
    """
    if not GRAM <= length <= GRAM + 60:
        raise ValueError(f"length must be from {GRAM} to {GRAM + 60}")
    anchors = _anchors(docs, length)
    recurring = anchors.groupBy("gram").agg(
        F.count("*").alias("n_all"), F.min("whole").alias("least"), F.max("whole").alias("most")
    )
    recurring = recurring.filter("n_all > 1").select(
        F.col("gram").alias("_gram"), (F.col("least") != F.col("most")).alias("several"),
        (F.col("n_all") > crowd).alias("crowded"),
    )
    # Stored, so that the join can be split where an anchor is hot.
    found = stored(anchors.join(stored(recurring), F.col("gram") == F.col("_gram")).drop("_gram"))
    full = F.expr("shiftleft(1L, n) - 1")
    # All passages of these anchors are equal, so each of their windows occurs as often as they.
    alike = found.filter(~F.col("several")).select(*KEY, "at", "n", full.alias("bits"))

    different = found.filter("several").groupBy("gram", "whole").agg(
        F.count("*").alias("times"), F.first("crowded").alias("crowded"),
        F.min(F.struct(*KEY, "at", "n", "place")).alias("one"),
    )
    place = F.struct("gram", "whole", "one.at", "one.n", "one.place", "times", "crowded")
    wanted = different.groupBy(F.col("one._k1").alias("_k1"), F.col("one._k2").alias("_k2")).agg(
        F.collect_list(place).alias("places")
    )
    excerpts = stored(_excerpts(docs.select(*KEY, "text"), wanted, length))
    words = excerpts.filter("not crowded").agg(F.sum(F.col("n") + (length - 1))).first()[0] or 0
    n_shards = max(1, -(-words // SHARD_WORDS))
    bits = _by_automaton(excerpts.filter("not crowded"), n_shards, length)
    for more in _by_halves(excerpts.filter("crowded"), length):
        bits = bits.unionByName(more)
    # Documents that repeat as rows give their passages more than once.
    bits = stored(bits.groupBy("gram", "whole").agg(F.bit_or("bits").alias("bits")).filter("bits <> 0"))
    bits = bits.select(F.col("gram").alias("_g"), F.col("whole").alias("_w"), "bits")
    partly = found.filter("several").join(bits, (F.col("gram") == F.col("_g")) & (F.col("whole") == F.col("_w")))
    both = alike.unionByName(partly.select(*KEY, "at", "n", "bits"))
    return both.groupBy(*KEY).agg(F.collect_set(F.struct("at", "n", "bits")).alias("spans"))


def covered(n_words: int, at: np.ndarray, bits: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each word lies in a removed window."""
    edge = np.zeros(n_words + 1, np.int64)
    i, k = np.nonzero(bits[:, None] >> np.arange(length - GRAM + 1, dtype=np.int64) & 1)
    starts = at[i] + k
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(docs: DataFrame, added: list[tuple[str, str]], make, drop=("text",), length: int = LENGTH) -> DataFrame:
    """Joins `repeats` to `docs`; `make(raw text, words, removed)` gives the added columns of a row."""
    keyed = _keyed(docs)
    spans = repeats(keyed, length).select(F.col("_k1").alias("_j1"), F.col("_k2").alias("_j2"), "spans")
    rows = keyed.join(spans, (F.col("_k1") == F.col("_j1")) & (F.col("_k2") == F.col("_j2")), "left")
    names = [n for n, _ in added]
    keep = [f for f in docs.schema.fields if f.name not in (*drop, *names, *KEY)]
    rows = rows.select(*(F.col(f"`{f.name}`") for f in keep), F.col("text").alias("_text"), "spans")
    new = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in added])
    kinds = to_arrow_schema(new).types
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = buffers(batch.column(n_keep))
            given, spans = batch.column(n_keep), batch.column(n_keep + 1)
            out = []
            for i in range(batch.num_rows):
                text = raw[bounds[i] : bounds[i + 1]].tobytes()
                words = text.split()
                removed = np.zeros(len(words), bool)
                if spans[i].is_valid:
                    at, _, bits = (f.to_numpy() for f in spans[i].values.flatten())
                    removed = covered(len(words), at.astype(np.int64), bits, length)
                out.append(make(text if given[i].is_valid else None, words, removed))
            columns = [pa.array([r[k] for r in out], kinds[k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n_keep)), *columns], [*(f.name for f in keep), *names]
            )

    return rows.mapInArrow(released(run), T.StructType(keep + new.fields))


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`(doc_id, n_words, n_removed, kept_sha256)` of each row of `docs` (doc_id, text).

    Words are runs of anything but ASCII white space. Every word in a window of `length` words
    that also starts anywhere else, in the same document or another, is removed; windows are
    judged on the input. Null and empty texts have no words. Rows that repeat are occurrences of
    their own. An empty table gives an empty table. More columns are ignored.
    """

    def make(_, words, removed):
        left = b" ".join([w for w, r in zip(words, removed) if not r])
        return len(words), int(removed.sum()), hashlib.sha256(left).hexdigest()

    fields = [("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")]
    return _cut(docs.select("doc_id", "text"), fields, make, length=length)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with `text` cut: removed words go with the white space before them.

    The words that stay keep the white space between them, so lines and paragraphs stay. A text
    without repeats is unchanged, null stays null.
    """

    def make(text, words, removed):
        if text is None or not removed.any():
            return [None if text is None else text.decode("utf-8", "replace")]
        out, at = [], 0
        for word, gone in zip(words, removed):
            start = text.index(word, at)
            if not gone:
                out.append(text[at : start + len(word)])
            at = start + len(word)
        out.append(text[at:])
        return [b"".join(out).strip().decode("utf-8", "replace")]

    columns = [f.name for f in docs.schema.fields]
    return _cut(docs, [("text", "string")], make, length=length).select(*columns)


OP6_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l
  FROM documents
), w AS (SELECT r, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS i, len(l) AS n FROM d),
g AS (
  SELECT r, i, word, CASE WHEN i + {LENGTH - 1} <= n THEN md5(string_agg(word, ' ') OVER (
    PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING)) END AS gram FROM w
), c AS (SELECT *, gram IS NOT NULL AND count(*) OVER (PARTITION BY gram) > 1 AS twice FROM g),
m AS (
  SELECT *, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM c
), a AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (r)"""


def op6_substrings(spark, sf: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf}/documents.parquet"))
