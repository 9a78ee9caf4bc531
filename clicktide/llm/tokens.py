"""Token counts that follow edits: pre-token trees per document, re-encoded only where touched."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

RANKS = "byte_bpe_50k.tiktoken"
# Pre-tokens of one leaf when a tree is built; leaves grow and shrink with edits.
LEAF = 64
# Code points behind a pre-token that its end can depend on: "'re" and a blank before a word.
LOOK = 2
# Columns of a stored tree.
TREE = ("lengths", "tokens", "sums")
KINDS = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
CACHED = 1 << 17
CACHED_CHARS = 32

# Personal data and secrets that the registered query cuts out, and what replaces them.
SCRUBBED = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "<email>"),
    (r"\b(?:AKIA[0-9A-Z]{16}|sk_live_[0-9A-Za-z]{16,}|gh[pousr]_[0-9A-Za-z]{20,}|[0-9a-f]{32,})\b", "<secret>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<address>"),
    (r"(?<![\w.])\+?\d[\d ()-]{7,}\d(?!\w)", "<number>"),
]

_encoders: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Tokens of pre-tokens, remembered for the short ones."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.pattern = regex.compile(pattern)
        self._known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self._known
        if len(known) > CACHED:
            known.clear()
        out = []
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = len(self._encode(p))
                if len(p) <= CACHED_CHARS:
                    known[p] = n
            out.append(n)
        return out


def counter(path: str | None = None) -> PieceCounter:
    import public_tokenizers

    path = path or public_tokenizers.path(RANKS)
    if path not in _encoders:
        _encoders[path] = PieceCounter(path, public_tokenizers.PATTERN)
    return _encoders[path]


def leaf_sums(lengths: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The nodes of a new tree over pre-tokens, root at 1: code points, tokens, pre-tokens below each."""
    starts = np.arange(0, max(len(lengths), 1), LEAF)
    size = 1 << (len(starts) - 1).bit_length()
    sums = np.zeros((2 * size, 3), np.int64)
    if len(lengths):
        leaves = sums[size : size + len(starts)]
        leaves[:, 0], leaves[:, 1] = np.add.reduceat(lengths, starts), np.add.reduceat(tokens, starts)
        leaves[:, 2] = np.diff(np.append(starts, len(lengths)))
    while size > 1:
        size //= 2
        sums[size : 2 * size] = sums[2 * size : 4 * size : 2] + sums[2 * size + 1 : 4 * size : 2]
    return sums


class TokenTree:
    """Segment tree over the pre-tokens of one text: code points, tokens and pre-tokens by subtree.

    A leaf holds a run of pre-tokens; inner nodes hold the sums of what is below, and are stored with
    the text, so that a tree is opened without a look at its leaves. A pre-token depends on nothing
    before its start and on at most LOOK code points after its end. So an edit touches pre-tokens
    from the first that ends less than that before it, up to the first old boundary that the new split
    meets again behind the edit; all others are left as they are. Only the leaves that hold touched
    pre-tokens are taken out of the stored arrays, and only their paths to the root are summed
    again. A leaf that has grown to eight times its size makes the tree be dealt into leaves anew.
    """

    def __init__(self, text: str, lengths, tokens, sums=None):
        self._stored = text, np.asarray(lengths, np.int32), np.asarray(tokens, np.int32)
        self._origin = leaf_sums(*self._stored[1:]) if sums is None else np.asarray(sums, np.int64).reshape(-1, 3)
        self._sums = self._origin.copy()
        self._size = len(self._sums) // 2
        # Leaves taken out so far: their lengths, tokens and text, as edits left them.
        self._open: dict[int, tuple[list[int], list[int], str]] = {}
        self.reencoded = 0

    @property
    def n_chars(self) -> int:
        return int(self._sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self._sums[1, 1])

    @property
    def sums(self) -> np.ndarray:
        return self._sums

    @property
    def opened(self) -> int:
        return len(self._open)

    def _before(self, leaf: int) -> tuple[int, int]:
        """Code points and pre-tokens that were stored before a leaf."""
        node, chars, pieces = self._size + leaf, 0, 0
        while node > 1:
            if node % 2:
                chars += int(self._origin[node - 1, 0])
                pieces += int(self._origin[node - 1, 2])
            node //= 2
        return chars, pieces

    def _content(self, leaf: int) -> tuple[list[int], list[int], str]:
        if leaf not in self._open:
            text, lengths, tokens = self._stored
            chars, pieces = self._before(leaf)
            n_chars, _, n = self._origin[self._size + leaf].tolist()
            own = slice(pieces, pieces + n)
            self._open[leaf] = lengths[own].tolist(), tokens[own].tolist(), text[chars : chars + n_chars]
        return self._open[leaf]

    def _joined(self, part: int) -> list:
        """Text (2), lengths (0) or tokens (1) in order: opened leaves, and what is stored between."""
        stored = (self._stored[1], self._stored[2], self._stored[0])[part]
        column = 0 if part == 2 else 2
        out, done = [], 0
        for leaf in sorted(self._open):
            start = self._before(leaf)[column // 2]
            out += [stored[done:start], self._open[leaf][part]]
            done = start + int(self._origin[self._size + leaf, column])
        return [*out, stored[done:]]

    def text(self) -> str:
        return "".join(self._joined(2))

    def pretokens(self) -> tuple[np.ndarray, np.ndarray]:
        lengths, tokens = (np.concatenate([np.asarray(x, np.int32) for x in self._joined(i)]) for i in (0, 1))
        return lengths, tokens

    def _leaf(self, at: int) -> tuple[int, int]:
        """(leaf, its start) of the first leaf that ends at code point `at` or later."""
        node, start = 1, 0
        while node < self._size:
            node *= 2
            if start + self._sums[node, 0] < at:
                start += int(self._sums[node, 0])
                node += 1
        return node - self._size, start

    def _put(self, leaf: int, lengths: list[int], tokens: list[int], text: str) -> None:
        """New content of a leaf; the sums on its path to the root follow."""
        self._open[leaf] = lengths, tokens, text
        node = self._size + leaf
        change = np.array([sum(lengths), sum(tokens), len(lengths)]) - self._sums[node]
        while node:
            self._sums[node] += change
            node //= 2

    def edit(self, count: PieceCounter, start: int, removed: int, inserted: str) -> None:
        """Replace `removed` code points from `start` by `inserted`; beyond the end they are cut."""
        start = max(0, min(start, self.n_chars))
        removed = max(0, min(removed, self.n_chars - start))
        touched = max(0, start - LOOK)
        leaf, before = self._leaf(touched)
        first, begin = 0, before
        sizes, counts, old = self._content(leaf)
        while first < len(sizes) and begin + sizes[first] < touched:
            begin += sizes[first]
            first += 1
        head = begin - before
        # Old text from the leaf on, one more leaf whenever the new split has not met the old one.
        last, left = leaf, self.n_chars - before
        while len(old) < min(start + removed + 1 - before, left):
            last += 1
            old += self._content(last)[2]
        cut, edge = start - before, start - before + len(inserted)
        shift = len(inserted) - removed
        while True:
            at_end = len(old) >= left
            new = old[:cut] + inserted + old[cut + removed :]
            bounds, place = {}, 0
            for k in range(leaf, last + 1):
                for j, size in enumerate(self._content(k)[0]):
                    if place >= cut + removed:
                        bounds[place + shift] = (k, j)
                    place += size
            pieces, met = [], None
            for match in count.pattern.finditer(new, head):
                seen = at_end or match.start() + LOOK <= len(new)
                if seen and match.start() >= edge and match.start() in bounds:
                    met = bounds[match.start()]
                    break
                pieces.append(match.group())
            if met is not None or at_end:
                break
            last += 1
            old += self._content(last)[2]
        self.reencoded += len(pieces)
        middle = "".join(pieces)
        rest_leaf, rest = met if met is not None else (last, len(self._content(last)[0]))
        rest_sizes, rest_counts, rest_text = self._content(rest_leaf)
        tail = rest_sizes[rest:], rest_counts[rest:], rest_text[len(rest_text) - sum(rest_sizes[rest:]) :]
        kept = sizes[:first] + list(map(len, pieces)), counts[:first] + count.counts(pieces), old[:head] + middle
        if rest_leaf == leaf:
            self._put(leaf, *(a + b for a, b in zip(kept, tail)))
        else:
            self._put(leaf, *kept)
            for k in range(leaf + 1, rest_leaf):
                self._put(k, [], [], "")
            self._put(rest_leaf, *tail)
        if len(self._open[leaf][0]) > 8 * LEAF:
            done = self.reencoded
            self.__init__(self.text(), *self.pretokens())
            self.reencoded = done


def build_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`docs` with the tree of each `text`: `lengths`, `tokens` and `sums`, to be stored with it.

    `lengths` and `tokens` are the code points and tokens of each pre-token, `sums` the nodes over leaves
    of LEAF pre-tokens each, three numbers a node (`leaf_sums`). Null and empty texts have no pre-tokens
    and a root of zeros. One narrow pass; columns of these names are replaced.
    """
    at = [i for i, c in enumerate(docs.columns) if c.lower() not in TREE]
    keep = [docs.schema.fields[i] for i in at]
    at_text = docs.columns.index("text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            # Some rows at a time: leaves take more room than their text.
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lengths, tokens, sums = [], [], []
                for text in part.column(at_text):
                    pieces = count.pattern.findall(text.as_py() or "")
                    lengths.append(np.fromiter(map(len, pieces), np.int32, len(pieces)))
                    tokens.append(np.array(count.counts(pieces), np.int32))
                    sums.append(leaf_sums(lengths[-1], tokens[-1]).ravel())
                new = [pa.array(x, kind) for x, kind in zip((lengths, tokens, sums), KINDS)]
                names = [*(f.name for f in keep), *TREE]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in at), *new], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return docs.mapInArrow(build, f"{fields}, lengths array<int>, tokens array<int>, sums array<long>")


def apply_edits(trees: DataFrame, path: str | None = None) -> DataFrame:
    """`trees` after the edits in its column `edits`, with `n_tokens_before, n_tokens, n_edits, n_reencoded`.

    `edits` is an array of (start, removed, inserted), in code points of the text as the edits
    before it left it; null means none. To apply a table of edits, collect it by doc_id and join
    it to the stored trees. Texts and trees are the new ones, ready to be stored again.
    `n_reencoded` counts the pre-tokens that were encoded anew, whatever the text's length. An edit
    opens the leaves it touches and follows their paths to the root; the rest of a row is copied.

    Null and empty texts are edited as empty ones; edits beyond the end are cut to it. Each row is
    edited for itself, so rows may repeat. An empty table gives an empty table. Columns named like an
    added one are replaced, others pass through.
    """
    names = trees.columns
    at = {c: names.index(c) for c in ("text", *TREE, "edits")}
    added = {"n_tokens_before", "n_tokens", "n_edits", "n_reencoded", *at}
    kept_at = [i for i, f in enumerate(trees.schema.fields) if f.name.lower() not in added]
    keep = [trees.schema.fields[i] for i in kept_at]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                col = {c: part.column(i) for c, i in at.items()}
                rows = [[] for _ in range(8)]
                for i in range(part.num_rows):
                    lengths, tokens, sums = (
                        col[c][i].values.to_numpy() if col[c][i].is_valid else np.zeros(0, np.int64) for c in TREE
                    )
                    edits, text = col["edits"][i].as_py() or [], col["text"][i].as_py()
                    tree = TokenTree(text or "", lengths, tokens, sums if len(sums) else None)
                    before = tree.n_tokens
                    for e in edits:
                        tree.edit(count, e["start"], e["removed"], e["inserted"])
                    if edits:
                        text, (lengths, tokens) = tree.text(), tree.pretokens()
                    new = text, lengths, tokens, tree.sums.ravel(), before, tree.n_tokens, len(edits), tree.reencoded
                    for column, value in zip(rows, new):
                        column.append(value)
                kinds = [pa.string(), *KINDS, *[pa.int64()] * 4]
                new = [pa.array(r, k) for r, k in zip(rows, kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept_at), *new], out)

    out = [*(f.name for f in keep), "text", *TREE, "n_tokens_before", "n_tokens", "n_edits", "n_reencoded"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return trees.mapInArrow(
        apply,
        f"{fields}text string, lengths array<int>, tokens array<int>, sums array<long>, "
        "n_tokens_before long, n_tokens long, n_edits long, n_reencoded long",
    )


def scrub_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace what SCRUBBED finds, leftmost first, earlier patterns before later ones."""
    found, taken = [], []
    for pattern, mark in SCRUBBED:
        for m in regex.finditer(pattern, text):
            if all(m.end() <= a or m.start() >= b for a, b in taken):
                taken.append(m.span())
                found.append((m.start(), m.end() - m.start(), mark))
    out, shift = [], 0
    for start, removed, mark in sorted(found):
        out.append((start + shift, removed, mark))
        shift += len(mark) - removed
    return out


def with_scrub_edits(docs: DataFrame) -> DataFrame:
    """`docs` with `edits`, as `apply_edits` takes them, that cut out personal data and secrets.

    Null and empty texts, and texts without such data, have no edits. Rows may repeat, an empty table
    stays empty. A column `edits` is replaced, others pass through.
    """
    at_text = docs.columns.index("text")
    kept_at = [i for i, c in enumerate(docs.columns) if c.lower() != "edits"]
    keep = [docs.schema.fields[i] for i in kept_at]
    names = [f.name for f in keep]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("removed", pa.int64()), ("inserted", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = [
                [dict(zip(("start", "removed", "inserted"), e)) for e in scrub_edits(t.as_py() or "")]
                for t in batch.column(at_text)
            ]
            kept = [batch.column(i) for i in kept_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(edits, kind)], [*names, "edits"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return docs.mapInArrow(find, f"{fields}, edits array<struct<start: long, removed: long, inserted: string>>")


def op4_token_counts(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    counted = apply_edits(build_trees(with_scrub_edits(docs)))
    return counted.select("doc_id", "n_tokens_before", "n_tokens", "n_edits", "n_reencoded")
