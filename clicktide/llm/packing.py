"""Packing tokenised documents into sequences by minimum bin slack."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clicktide.llm.storage import numbered, stored
from clicktide.llm.text import LOWER, WHITE, Slice, release, slices

CAPACITY = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
# Ids that a window may lack of being full; they are padded.
SLACK = 16
# Bounds of the two tables of known words in each Python worker.
CACHED_WORDS = 1 << 19
CACHED_BYTES = 32
# New words that are encoded as one text.
JOINED = 1000

_encoders: dict[str, "WordEncoder | TextEncoder"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def separated(part: Slice) -> tuple[bytes, np.ndarray]:
    """(text of a slice, bounds of each document's words in it).

    A blank ends each document. A-Z are in lower case and a blank stands before a stop or comma
    that ends a word: the tokenizer lower-cases anyway and starts a new piece at such a stop, so
    ids stay the same, but fewer different words are left. Texts that may hold special tokens are
    left as they are.
    """
    raw, bounds = part.raw, part.bounds
    at = bounds[1:]
    if len(raw) and b"<|" not in raw.tobytes():
        raw = LOWER[raw]
        last = np.append(WHITE[raw[1:]], True)
        last[bounds[1:][bounds[1:] > 0] - 1] = True
        stop = ((raw == ord(".")) | (raw == ord(","))) & last
        letter = (raw >= ord("a")) & (raw <= ord("z"))
        stop[1:] &= letter[:-1]
        stop[bounds[:-1][bounds[:-1] < len(raw)]] = False
        at = np.sort(np.concatenate([np.flatnonzero(stop), at]))
    raw = np.insert(raw, at, 32)
    word = ~WHITE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    # Each document ends behind the blanks put in up to its end.
    ends = bounds[1:] + np.searchsorted(at, bounds[1:], "right")
    words = np.concatenate([[0], np.cumsum(first)])
    return raw.tobytes(), words[np.concatenate([[0], ends])]


# Steps of a tokenizer before its model under which words can be encoded one by one. They
# lower-case, keep letters, single digits and other marks apart, and drop white space.
BY_WORD = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def encodes_by_word(config: dict) -> bool:
    """Whether a tokenizer gives a text the ids of its words, as `separated` cuts them."""
    steps = (config.get("normalizer") or {}).get("normalizers")
    cut, *others = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = cut.get("type") == "Split" and (cut.get("behavior"), cut.get("invert")) == ("Removed", True)
    plain = [(o.get("type"), o.get("add_prefix_space"), o.get("use_regex")) for o in others] == [("ByteLevel", False, False)]
    model = config.get("model") or {}
    return (
        steps == BY_WORD["normalizer"] and split and cut["pattern"] == {"Regex": BY_WORD["pattern"]} and plain
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        and all(not t["normalized"] and t["content"].startswith("<|") for t in config.get("added_tokens") or [])
    )


class TextEncoder:
    """Ids of whole texts, for any tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)

    def of_slice(self, part: Slice) -> Iterator[bytes]:
        for a, b in zip(part.bounds, part.bounds[1:]):
            text = part.raw[a:b].tobytes().decode("utf-8", "replace")
            (found,) = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)
            yield np.array(found.ids, "<u4").tobytes()

    def rest(self) -> None:
        """Nothing is remembered."""


class WordEncoder:
    """Ids of texts for a tokenizer that `encodes_by_word`: words are encoded once and remembered.

    Such a tokenizer never joins characters across white space, so that the ids of a text are
    those of its words, one after the other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        size = self._tokenizer.get_vocab_size()
        names = [self._tokenizer.id_to_token(i) or "" for i in range(size)]
        self._ends = np.array([name.endswith("</w>") for name in names])
        # Words seen lately, and those before: words that come again move to the first.
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _fresh(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words. Words of a-z are one piece each: many are encoded as one text."""
        plain = [w for w in words if w.isalpha() and w.islower()]
        mixed = [w for w in words if not (w.isalpha() and w.islower())]
        ids = self._encode([w.decode("utf-8", "replace") for w in mixed])
        fresh = {w: i.tobytes() for w, i in zip(mixed, ids)}
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, ids in zip(groups, self._encode([b" ".join(g).decode() for g in groups])):
            cuts = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            if len(cuts) != len(group):
                raise ValueError("the tokenizer does not mark the ends of words")
            flat, at = ids.tobytes(), 0
            for word, cut in zip(group, cuts):
                fresh[word] = flat[at:cut]
                at = cut
        return fresh

    def ids(self, text: bytes, bounds: np.ndarray) -> Iterator[bytes]:
        """Ids of documents as unsigned 32-bit little-endian numbers; see `separated`."""
        words = text.split()
        found = list(map(self._known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = {words[i] for i in missing}
            fresh = {w: self._older[w] for w in new if w in self._older}
            fresh |= self._fresh([w for w in new if w not in fresh])
            for i in missing:
                found[i] = fresh[words[i]]
            if len(self._known) + len(fresh) > CACHED_WORDS:
                self._known, self._older = {}, self._known
            self._known.update((w, ids) for w, ids in fresh.items() if len(w) <= CACHED_BYTES)
        at = bounds.tolist()
        for a, b in zip(at, at[1:]):
            yield b"".join(found[a:b])

    def of_slice(self, part: Slice) -> Iterator[bytes]:
        return self.ids(*separated(part))

    def rest(self) -> None:
        """Leaves the memory of the older table to what the worker does next."""
        self._older = {}


def encoder(path: str) -> WordEncoder | TextEncoder:
    """The encoder of a tokenizer file: by word where that gives the same ids, else by text."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as lines:
            by_word = encodes_by_word(json.load(lines))
        _encoders[path] = WordEncoder(path) if by_word else TextEncoder(path)
        release()
    return _encoders[path]


def digits(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """`(doc_id, start, length, crc, doc_tokens, parts)`: each document cut at multiples of `capacity`.

    `crc` is the CRC-32 of the piece's ids, `parts` those of the powers of two that it can be cut
    into, largest first.
    """
    end = np.array([end_id], "<u4").tobytes()
    at_doc, at_text = docs.columns.index("doc_id"), docs.columns.index("text")
    names = ["doc_id", "start", "length", "crc", "doc_tokens", "parts"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            docs_at, starts, lengths, crcs, totals, parts = [], [], [], [], [], []
            for part in slices(batch.column(at_text)):
                for i, ids in enumerate(encode.of_slice(part)):
                    view = memoryview(ids + end)
                    total = len(view) // 4
                    for start in range(0, total, capacity):
                        length = min(capacity, total - start)
                        piece = view[4 * start : 4 * (start + length)]
                        docs_at.append(part.first + i)
                        starts.append(start)
                        lengths.append(length)
                        crcs.append(zlib.crc32(piece))
                        totals.append(total)
                        own, done = [], 0
                        for size in digits(length) if length < capacity else ():
                            own.append(zlib.crc32(piece[4 * done : 4 * (done + size)]))
                            done += size
                        parts.append(own)
            longs = [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]
            doc = batch.column(at_doc).take(pa.array(docs_at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [doc, *longs, pa.array(parts, pa.list_(pa.int64()))], names
            )
        encode.rest()
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        cut, f"doc_id {kind}, start long, length long, crc long, doc_tokens long, parts array<long>"
    )


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """`(length, how often)` whose sum is as close to `room` as it gets, from the given counts.

    Subset sums as bits of one number; counts are taken in powers of two. Lengths are added from
    the largest, until the room is filled exactly; then the choice is read off backwards. If it
    cannot be filled exactly, the sum is the largest.
    """
    sums, steps = 1, []
    every = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & every
            left -= take
            take *= 2
        if sums >> room & 1:
            break
    at = sums.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


@dataclass
class Plan:
    """Which window each piece goes to, by its rank among the pieces of its length."""

    # Sequences, and for each run of ranks of a length: (length, first rank, first sequence or -1
    # for pieces that are cut into powers of two, pieces per sequence, offset in it).
    sequences: int
    runs: list[tuple[int, int, int, int, int]]
    # Pieces of each length before and after cutting.
    whole: dict[int, int]
    total: dict[int, int]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, slack: int = SLACK) -> Plan:
    """Minimum bin slack over a histogram of lengths up to `capacity`.

    Each window starts with the longest length left and is filled by `fill`. The choice is used
    for as many windows as the counts allow, so that the work depends on the number of lengths
    and not on the number of pieces. A window that lacks up to `slack` ids of being full is padded. If
    it lacks more, some pieces of its longest length are cut into powers of two, which fill other
    windows or, at last, make sequences of their own, which need no padding.
    """
    left = {k: v for k, v in histogram.items() if v}
    whole, total = dict(left), dict(left)
    ranks: dict[int, int] = {}
    runs, sequences = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        others = fill(left, capacity - longest)
        left[longest] += 1
        close = longest + sum(k * n for k, n in others) >= capacity - slack
        if not close and longest & (longest - 1):
            n = -(-left[longest] // 8)
            # Cut pieces are the last of their length; all ranks before them stay free.
            whole[longest] -= n
            left[longest] -= n
            if not left[longest]:
                del left[longest]
            for size in digits(longest):
                left[size] = left.get(size, 0) + n
                total[size] = total.get(size, 0) + n
            continue
        used: dict[int, int] = {longest: 1}
        for k, n in others if close else ():
            used[k] = used.get(k, 0) + n
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for k, n in used.items():
            runs.append((k, ranks.get(k, 0), sequences, n, offset))
            ranks[k] = ranks.get(k, 0) + n * times
            offset += k * n
            left[k] -= n * times
            if not left[k]:
                del left[k]
        sequences += times
    for k, n in histogram.items():
        if whole.get(k, 0) < n:
            runs.append((k, whole[k], -1, 1, 0))
    return Plan(sequences, sorted(runs), whole, total)


def _placed(rows: DataFrame, chosen: Plan, counts: dict[int, int], skip: dict[int, int]) -> DataFrame:
    """`rows` numbered along their length, with `sequence_id` and `offset`.

    `counts` are the rows of each length, `skip` the ranks of each length that come before them.
    """
    lengths = sorted(set(counts) | set(chosen.total))
    before = np.cumsum([0] + [counts.get(k, 0) for k in lengths])[:-1]
    span = [max(chosen.total.get(k, 0), counts.get(k, 0) + skip.get(k, 0)) for k in lengths]
    base = np.cumsum([0] + span)[:-1]
    place = {k: i for i, k in enumerate(lengths)}
    runs = np.array(chosen.runs, np.int64).reshape(-1, 5)
    starts = np.array([base[place[k]] for k in runs[:, 0].tolist()], np.int64) + runs[:, 1]
    skipped = np.array([skip.get(k, 0) for k in lengths], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(
        (np.array(lengths, np.int64), base - before + skipped, starts, runs)
    )
    names = rows.columns
    at_length, at_number = names.index("length"), names.index("_number")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shift, starts, runs = shared.value
        for batch in batches:
            length = batch.column(at_length).to_numpy(zero_copy_only=False)
            number = batch.column(at_number).to_numpy(zero_copy_only=False)
            number = number + shift[np.searchsorted(known, length)]
            run = np.searchsorted(starts, number, "right") - 1
            nth, (_, _, first, each, offset) = number - starts[run], runs[run].T
            sequence = np.where(first < 0, -1, first + nth // each)
            new = [pa.array(sequence), pa.array(offset + nth % each * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(look_up, f"{fields}, sequence_id long, offset long")


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """`(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)` of every piece.

    A document's ids, followed by `end_id`, are cut at multiples of `capacity`; the rests are packed
    by `plan`, which sees only how many there are of each length (at most `capacity` rows). A
    sequence's pieces lie side by side from 0. Sequences have a power of two of ids, or lack at most
    SLACK of being full. `capacity` must be a power of two. `path` names any tokenizer file; those that
    `encodes_by_word` run faster, others encode text by text.

    Null and empty texts have the end id alone. Rows may repeat, and doc_id may be null or repeat:
    each row is packed for itself. An empty table gives an empty table. Columns other than doc_id
    and text are ignored.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    cut = stored(pieces(docs.select("doc_id", "text"), path or tokenizer_path(), capacity, end_id))
    order = [F.col(c) for c in ("length", "doc_id", "start", "crc")]
    ranked = numbered(cut, order, "_number")
    counts = {r.length: r["count"] for r in ranked.groupBy("length").count().collect()}
    chosen = plan(counts, capacity)
    placed = _placed(ranked, chosen, counts, {})
    out = ["doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    result = placed.filter("sequence_id >= 0").select(*out)
    broken = {k: n - chosen.whole[k] for k, n in counts.items() if chosen.whole[k] < n}
    if not broken:
        return result
    added: dict[int, int] = {}
    for k, n in broken.items():
        for size in digits(k):
            added[size] = added.get(size, 0) + n
    every = F.array(*(F.lit(size).cast("long") for size in digits(2 * capacity - 1)))
    powers = F.filter(every, lambda size: F.col("length").bitwiseAND(size) != 0)
    sized = placed.filter("sequence_id < 0").withColumn("_sizes", powers)
    part = F.posexplode(F.arrays_zip(F.col("_sizes").alias("size"), F.col("parts").alias("sum")))
    done = F.aggregate(F.expr("slice(_sizes, 1, _i)"), F.lit(0).cast("long"), lambda a, x: a + x)
    small = sized.select("doc_id", "start", "doc_tokens", "_sizes", part.alias("_i", "_part")).select(
        "doc_id",
        (F.col("start") + done).alias("start"),
        F.col("_part.size").alias("length"),
        F.col("_part.sum").alias("crc"),
        "doc_tokens",
    )
    again = _placed(numbered(small, order, "_number"), chosen, added, chosen.whole)
    return result.unionByName(again.select(*out))


def op5_pack(spark, sf: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf}/documents.parquet"))
