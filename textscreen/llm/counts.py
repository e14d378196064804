"""Token counts that follow edits without encoding a text again.

A document's pre-tokens are the leaves of a segment tree whose nodes hold the
characters and tokens below them. A first pass (``build``) encodes every text once
and stores its tree, one row a document, by its leaves: an array of one number a
pre-token, ``characters << 32 | tokens``, from which the sums above follow. Later passes (``apply_edits``) read the stored rows and touch only
those with edits. An edit finds its leaves by character offset, splits only the text
from a little before it up to the first place after it where the new split meets an
old boundary, encodes that, and renews the sums above. Pre-tokens look at most
``AHEAD`` characters past their end and never back, so the split outside that stretch
is what a full run would give. What comes out can be stored and edited again.

Null texts count as empty. Edits are ``(start, stop, replacement)`` in characters
of the original text; they apply in order of start, a null replacement deletes,
offsets beyond the text are cut to it, and an edit that is null, reversed or begins
inside an earlier one is left out and not counted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F, types as T

from .blocks import per_row
from .bpe import read_ranks

AHEAD = 2
KEPT = 300_000  # pre-tokens whose count is kept in a worker

Edit = tuple[int, int, str | None]
CROWDED = 16  # pieces that a leaf takes in beyond its own before all are dealt anew
COUNTS = "n_tokens_before long, n_edits long, n_tokens_after long, n_reencoded long, n_pieces long"


class Counter:
    """Tokens of single pre-tokens, with a table of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def of(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > KEPT:
            known.clear()
        for piece in set(pieces).difference(known):
            known[piece] = len(self.encoding.encode_ordinary(piece))
        return [known[piece] for piece in pieces]


class Tree:
    """A text and its pre-tokens; leaves keep their number, an edit refills those it touches.

    A leaf that takes in more pieces than it has place for holds them together until
    there are more than ``CROWDED``; then all leaves are dealt anew.
    """

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, counter: Counter):
        self.text, self.counter, self.reencoded = text, counter, 0
        self._deal(chars, tokens)

    def _deal(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.count = max(1, len(chars))
        self.size = 1 << max(0, len(chars) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(chars)], self.tokens[self.size : self.size + len(chars)] = chars, tokens
        self.packed: dict[int, tuple[list[int], list[int]]] = {}
        level = self.size
        while level > 1:
            half = level // 2
            for sums in (self.chars, self.tokens):
                sums[half:level] = sums[level : 2 * level].reshape(-1, 2).sum(1)
            level = half

    def total(self) -> int:
        return int(self.tokens[1])

    def leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of every pre-token."""
        chars, tokens = [], []
        own = zip(self.chars[self.size : self.size + self.count].tolist(), self.tokens[self.size : self.size + self.count].tolist())
        for k, (c, t) in enumerate(own):
            if k in self.packed:
                chars += self.packed[k][0]
                tokens += self.packed[k][1]
            elif c:
                chars.append(c)
                tokens.append(t)
        return chars, tokens

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds a character offset, and where the leaf begins; the last leaf for the end."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if offset >= start + self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Replace the characters ``[start, stop)`` of the text as it is now."""
        length = len(self.text)
        # The first leaf that could look into the edit, or touches it.
        first, begin = self.find(max(0, start - AHEAD - 1))
        last, last_begin = self.find(max(stop - 1, start) if stop < length or start < length else max(0, length - 1))
        shift = len(replacement) - (stop - start)
        end, settled = max(last_begin + int(self.chars[self.size + last]), stop) + shift, start + len(replacement)
        self.text = self.text[:start] + replacement + self.text[stop:]
        more, window = last + 1, 4
        while True:
            upto = max(more, min(self.count, more + window))
            borders, at = {end: last}, end
            for k in range(more, upto):
                at += int(self.chars[self.size + k])
                borders[at] = k
            complete = upto >= self.count
            seen = self.text[begin:at]
            pieces, region = [], upto - 1
            for match in self.counter.split.finditer(seen):
                pieces.append(match.group())
                place = begin + match.end()
                if place >= settled and place in borders and place + AHEAD < at:
                    region, complete = borders[place], True
                    break
            if complete:
                break
            window *= 2
        self.fill(first, max(first, region), pieces)

    def fill(self, first: int, last: int, pieces: list[str]) -> None:
        """Put pieces into the leaves ``first..last``, what is left over into the last, and renew the sums above."""
        counts = self.counter.of(pieces)
        self.reencoded += len(pieces)
        room, lengths = last - first + 1, list(map(len, pieces))
        for k in range(room):
            mine, own = (lengths[k : k + 1], counts[k : k + 1]) if k < room - 1 else (lengths[k:], counts[k:])
            self.packed.pop(first + k, None)
            if len(mine) > 1:
                self.packed[first + k] = mine, own
            self.chars[self.size + first + k], self.tokens[self.size + first + k] = sum(mine), sum(own)
        if len(lengths) - room >= CROWDED:
            return self._deal(*map(np.array, self.leaves()))
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for sums in (self.chars, self.tokens):
                sums[low : high + 1] = sums[2 * low : 2 * high + 2].reshape(-1, 2).sum(1)
            low, high = low // 2, high // 2


def ordered(edits: list[Edit | None] | None, length: int) -> list[tuple[int, int, str]]:
    """The edits that apply, in order, within the text."""
    out, free = [], 0
    for start, stop, text in sorted((e for e in edits or () if e is not None and None not in e[:2]), key=lambda e: e[:2]):
        start, stop = max(0, min(start, length)), min(stop, length)
        if start <= stop and start >= free:
            out.append((start, stop, text or ""))
            free = max(stop, start)
    return out


def edited_tree(text: str, chars: np.ndarray, tokens: np.ndarray, edits: list[Edit | None] | None, counter: Counter) -> tuple[Tree, int]:
    """The tree after all edits, and how many there were."""
    tree, shift, todo = Tree(text, chars, tokens, counter), 0, ordered(edits, len(text))
    for start, stop, new in todo:
        tree.edit(start + shift, stop + shift, new)
        shift += len(new) - (stop - start)
    return tree, len(todo)


_counters: dict[tuple[str, str], Counter] = {}


def _counter(vocabulary: str, pattern: str) -> Counter:
    if (vocabulary, pattern) not in _counters:
        _counters.clear()
        _counters[vocabulary, pattern] = Counter(read_ranks(vocabulary if "/" in vocabulary else SparkFiles.get(vocabulary)), pattern)
    return _counters[vocabulary, pattern]


def build(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "tree") -> DataFrame:
    """``docs`` with the struct ``out`` of ``(leaves)``, the leaves of each text's tree; write the result.

    Rows stay as they are, repeated ones too; a column named ``out`` is replaced. No
    rows give no rows. ``pattern`` must match every character, as the split of a
    byte-level BPE does.
    """

    def measure(texts: pa.Array) -> pa.StructArray:
        counter = _counter(vocabulary, pattern)
        pieces = [counter.split.findall(x or "") for x in texts.to_pylist()]
        leaves = [_leaves(list(map(len, p)), counter.of(p)) for p in pieces]
        return pa.StructArray.from_arrays([pa.array(leaves, pa.list_(pa.int64()))], ["leaves"])

    return per_row(docs, text, measure, "leaves array<long>", out)


def _leaves(chars: list[int], tokens: list[int]) -> np.ndarray:
    return np.array(chars, np.int64) << 32 | np.array(tokens, np.int64)


def apply_edits(
    stored: DataFrame, vocabulary: str, pattern: str, edits: str | Callable[[str], list[Edit]], text: str = "text", tree: str = "tree", out: str = "counts", keep: bool = True
) -> DataFrame:
    """``stored`` rows of ``build`` with the struct ``out`` of counts, and with ``text`` and ``tree`` as the edits leave them.

    ``edits`` is a column of arrays of ``(start, stop, replacement)``, or a function of
    the text. Rows without edits are not encoded at all. ``n_reencoded`` of ``n_pieces``
    pre-tokens were encoded again. Without ``keep`` neither text nor tree comes back.
    """
    given = isinstance(edits, str)
    kept = [c for c in stored.columns if c != out and (keep or c not in (text, tree))]
    names = [x.split()[0] for x in COUNTS.split(", ")]
    source = stored.select(*[F.col(f"`{c}`") for c in kept], F.struct(F.col(f"`{text}`").alias("text"), F.col(f"`{tree}`").alias("tree"), *([F.col(f"`{edits}`").alias("edits")] if given else [])).alias("_read"))
    schema = T.StructType([*[stored.schema[c] for c in kept], T.StructField(out, T.StructType.fromDDL(COUNTS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary, pattern)
        for batch in batches:
            read = batch.column(len(kept))
            texts, trees = read.field("text").to_pylist(), read.field("tree").field("leaves")
            asked = [[e and tuple(e.values()) for e in row or ()] for row in read.field("edits").to_pylist()] if given else [edits(x or "") for x in texts]
            rows, after = [], {}
            for i, todo in enumerate(asked):
                leaves = trees[i].values.to_numpy() if trees[i].is_valid else np.zeros(0, np.int64)
                before = int((leaves & 0xFFFFFFFF).sum())
                made = (before, 0, before, 0, len(leaves))
                if todo:
                    new, n = edited_tree(texts[i] or "", leaves >> 32, leaves & 0xFFFFFFFF, todo, counter)
                    if n:
                        after[i] = new.text, _leaves(*new.leaves())
                        made = before, n, new.total(), new.reencoded, len(after[i][1])
                rows.append(made)
            columns = [batch.column(k) for k in range(len(kept))]
            if keep and after:
                for k, c in enumerate(kept):
                    if c == text:
                        columns[k] = pa.array([after[i][0] if i in after else x for i, x in enumerate(texts)], columns[k].type)
                    if c == tree:
                        lists = [after[i][1] if i in after else x for i, x in enumerate(trees.to_pylist())]
                        columns[k] = pa.StructArray.from_arrays([pa.array(lists, pa.list_(pa.int64()))], ["leaves"])
            sums = pa.StructArray.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(len(names))], names)
            yield pa.RecordBatch.from_arrays([*columns, sums], [*kept, out])

    return source.mapInArrow(run, schema)


#: What ``redactions`` replaces: mail addresses, IPv4 addresses, long numbers, quoted hexadecimal secrets.
SENSITIVE = re.compile(
    r"(?P<mail>[\w.+-]++@[\w-]++(?:\.[\w-]++)+)|(?P<address>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<secret>\b[0-9a-fA-F]{32,}+\b)|(?P<number>\b\d(?:[ -]?\d){8,}+\b)"
)

# None of them is in a text without this.
_HINT = re.compile(r"[@\d]|[0-9a-fA-F]{32}")


def redactions(text: str) -> list[Edit]:
    """Edits that put a placeholder in the place of personal data and secrets."""
    if not _HINT.search(text):
        return []
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in SENSITIVE.finditer(text)]
