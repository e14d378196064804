"""Byte-level BPE by recursive DuckDB queries inside each Spark partition.

A partition's texts are split into pre-tokens, and every distinct pre-token that is
no token itself becomes rows ``(word, pos, token)``, one per byte. A recursive
query joins neighbouring rows with the merge table and contracts each word's
leftmost pair of least rank, until no word has a pair left. A second query joins
the rows with the vocabulary and aggregates the bytes in order of position, which
decodes them. Spark deals the texts out; DuckDB works on one bounded set of words
at a time, in memory and single-threaded.

Words seen recently keep their result in a table of bounded size that is emptied
when full. Pre-tokens of more than ``LONG`` bytes (a text without any break) would
need one round per merge; they are merged by the same rule with a heap instead.
Null and empty texts have no tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import cut

LONG = 1_000
WORDS = 24_000  # words in one recursive query; each of its rounds hashes the merge table once
KEPT = 300_000  # words whose result is kept

_ENCODE = f"""
WITH RECURSIVE step(word, pos, token, round) AS (
    SELECT word, pos, token, 0 FROM start
    UNION ALL
    (
        WITH pairs AS (
            SELECT word, pos, token, round, lead(token) OVER w AS following, lag(pos) OVER w AS previous
            FROM step WINDOW w AS (PARTITION BY word ORDER BY pos)
        ),
        ranked AS (SELECT pairs.*, merged FROM pairs LEFT JOIN merges ON a = token AND b = following),
        best AS (
            SELECT word, min(merged::BIGINT * {LONG + 1} + pos) % {LONG + 1} AS place
            FROM ranked WHERE merged IS NOT NULL GROUP BY word
        )
        SELECT ranked.word, pos, CASE WHEN pos = place THEN merged ELSE token END, round + 1
        FROM ranked JOIN best ON ranked.word = best.word WHERE previous IS DISTINCT FROM place
    )
)
SELECT step.word, pos, token FROM step JOIN (SELECT word, max(round) AS last FROM step GROUP BY word) f ON f.word = step.word AND round = last
"""
_DECODE = "SELECT word, string_agg(bytes, '' ORDER BY pos) AS bytes FROM done JOIN vocabulary ON id = token GROUP BY word ORDER BY word"
_MERGES = """
CREATE TABLE merges AS
SELECT l.id AS a, r.id AS b, v.id AS merged
FROM (SELECT bytes, id, unnest(range(2, length(bytes), 2)) AS place FROM vocabulary) v
JOIN vocabulary l ON l.bytes = substr(v.bytes, 1, v.place) JOIN vocabulary r ON r.bytes = substr(v.bytes, v.place + 1)
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: one base64 token and its rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fixpoint for one long piece: pairs wait in a heap by rank and position."""
    after, before, ends = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1)), list(range(1, len(piece) + 1))
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        if 0 <= i and after[i] < len(piece):
            rank = ranks.get(piece[i : ends[after[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ends[after[i]]))

    for i in range(len(piece)):
        push(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if ends[i] < 0 or after[i] >= len(piece) or ends[after[i]] != end:
            continue  # one of the two has been merged meanwhile
        gone = after[i]
        ends[i], after[i], ends[gone] = end, after[gone], -1
        if after[i] < len(piece):
            before[after[i]] = i
        push(before[i])
        push(i)
    out, i = [], 0
    while i < len(piece):
        out.append(ranks[piece[i : ends[i]]])
        i = after[i]
    return out


class Encoder:
    """Distinct words to token ids and back, within one task."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.connection = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        vocabulary = pa.table({"bytes": pa.array([t.hex() for t in ranks]), "id": pa.array(list(ranks.values()), pa.int32())})  # noqa: F841
        self.connection.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.connection.execute(_MERGES)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.decoded: list[bytes] = []
        # Where each word's ids begin and end in one buffer that grows by doubling.
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not in the table yet."""
        pieces = [word.encode("utf-8", "surrogatepass") for word in words]
        made: list[np.ndarray | None] = [None] * len(words)
        decoded: list[bytes | None] = [None] * len(words)
        hard = []
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None or len(piece) > LONG:
                ids = [rank] if rank is not None else heap_merge(piece, self.ranks)
                made[i], decoded[i] = np.array(ids, np.int32), b"".join(self.tokens[x] for x in ids)
            else:
                hard.append(i)
        for at in range(0, len(hard), WORDS):
            chosen = hard[at : at + WORDS]
            lengths = np.array([len(pieces[i]) for i in chosen])
            data = np.frombuffer(b"".join(pieces[i] for i in chosen), np.uint8)
            offsets = np.cumsum(lengths) - lengths
            start = pa.table(  # noqa: F841
                {
                    "word": np.repeat(np.arange(len(chosen), dtype=np.int32), lengths),
                    "pos": (np.arange(len(data)) - np.repeat(offsets, lengths)).astype(np.int32),
                    "token": self.bytes[data],
                }
            )
            self.connection.execute(f"CREATE OR REPLACE TEMP TABLE done AS {_ENCODE}")
            rows = self.connection.execute("SELECT word, token FROM done ORDER BY word, pos").fetchnumpy()
            ends = np.searchsorted(rows["word"], np.arange(len(chosen) + 1))
            tokens = np.asarray(rows["token"], np.int32)
            back = self.connection.execute(_DECODE).fetchnumpy()["bytes"]
            for k, i in enumerate(chosen):
                made[i], decoded[i] = tokens[ends[k] : ends[k + 1]], bytes.fromhex(back[k])
        first, lengths = len(self.decoded), np.fromiter(map(len, made), np.int64, len(made))
        self.index.update(zip(words, range(first, first + len(words))))
        self.decoded += decoded
        self.starts, self.lengths = _room(self.starts, first + len(words)), _room(self.lengths, first + len(words))
        self.lengths[first : first + len(words)] = lengths
        self.starts[first : first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.ids, end = _room(self.ids, self.used + int(lengths.sum())), self.used + int(lengths.sum())
        self.ids[self.used : end] = np.concatenate(made)
        self.used = end

    def encode(self, texts: list[list[str]]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Token ids and decoded bytes of each text, given as its pre-tokens."""
        if len(self.index) > KEPT:
            self.clear()
        # Equal words are found by Arrow, so only distinct ones are looked up here.
        coded = pa.array(list(chain.from_iterable(texts)), pa.large_string()).dictionary_encode()
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        fresh = [word for word in distinct if word not in self.index]
        if fresh:
            self.learn(fresh)
        known = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        counts = self.lengths[known][at]
        ends = np.cumsum(counts)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[known][at] - (ends - counts), counts)]
        words = pa.array([self.decoded[i] for i in known.tolist()], pa.large_binary()).take(coded.indices)
        offsets = np.frombuffer(words.buffers()[1], np.int64) if len(words) else np.zeros(1, np.int64)
        data = words.buffers()[2]
        data, ends = data.to_pybytes() if data is not None else b"", np.concatenate([np.zeros(1, np.int64), ends])
        stops = np.cumsum(list(map(len, texts)), dtype=np.int64)
        for start, stop in zip([0, *stops.tolist()], stops.tolist()):
            yield ids[ends[start] : ends[stop]], data[offsets[start] : offsets[stop]]


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """The array itself if it holds ``size`` values, else a copy of at least twice its length."""
    if len(values) >= size:
        return values
    grown = np.zeros(max(size, 2 * len(values)), values.dtype)
    grown[: len(values)] = values
    return grown


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary; building its tables takes half a second."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(read_ranks(path))
    return _encoders[path]


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", emit: Callable | None = None, fields: str = "ids array<int>, decoded binary") -> DataFrame:
    """``(key, ids, decoded)`` per row of ``docs``, or what ``emit(ids, decoded)`` makes of them for ``fields``.

    ``vocabulary`` is a path that every executor can open, or the name of a file
    given to ``SparkContext.addFile``. Each match of ``pattern`` is encoded on its
    own, without special tokens; text between matches has none. Rows repeating a key
    are encoded each, other columns are left out, keys may be of any type, and an
    empty table gives no rows.
    """
    source = docs.select(key, text)
    schema = f"{source.schema[key].name} {source.schema[key].dataType.simpleString()}, {fields}"
    kind = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary if "/" in vocabulary else SparkFiles.get(vocabulary))
        find = regex.compile(pattern).findall
        types = [to_arrow_type(f.dataType) for f in kind.fields[1:]]
        for batch in batches:
            for part in cut(batch, text, 8 << 20):
                texts = [find(x or "") for x in part.column(text).to_pylist()]
                rows = [emit(*x) if emit else x for x in coder.encode(texts)]
                columns = [pa.array(list(x), t) for x, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([part.column(key), *columns], kind.names)

    return source.mapInArrow(run, kind)


def digests(ids: np.ndarray, decoded: bytes) -> tuple[int, str, str]:
    """Number of tokens, and SHA-256 of the ids as little-endian 32-bit integers and of the decoded bytes."""
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()
