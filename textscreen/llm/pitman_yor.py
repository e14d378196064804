"""A hierarchical Pitman-Yor language model over a corpus, and every text's log probability under it.

Restaurants: the root serves single words over a uniform base; every word that is
followed by another in training, and the start of a text, is a context with a
restaurant of its own whose parent is the root. Customers of a context are the
training tokens after it, those of the root one for each table below. Discounts come
from the counts of counts, concentrations are 1.

Seating is sampled by Gibbs. In a sweep every customer gets up once and is seated
again: all of a dish with up to ``JOINT`` of them together, by the law of their seats,
those of a larger one in groups, so that a dish takes some dozens of steps, however
many it has. A pair seen once has one table whatever is drawn; only the others move.
After ``BURN_IN`` sweeps the predictive probabilities of ``SAMPLES`` more are averaged.

Words fall into buckets by hash, as many as there are tokens for
(``BUCKET_TOKENS``). A word's bucket holds its pairs with all contexts, its dish at
the root, and, as the word is a context itself, that context's totals. Between sweeps
buckets tell each other the tables of their contexts, in an order fixed once, and the
driver sees two numbers, the root's customers and tables.

Text moves as blocks: per block of documents the word numbers of its tokens, its
distinct words and, for each bucket, the words and pairs it asks for; the answers
come back in the same order. Words are known by 64-bit hashes. What is stored or
shuffled is bytes: ascending numbers travel as differences, numbers that hardly differ
from others as what they differ by, and a step gets only the columns it reads.

A null or empty text has its end token only. Rows without a key are training rows;
repeated rows train and are scored once each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialise
from .blocks import Block, cut, mix

JOINT, LEAST_GROUPS, URN = 64, 4, 256
BURN_IN, SAMPLES = 2, 3
PIECE = 4 << 20  # bytes of text
BLOCK_TOKENS = 1_000_000
BUCKET_TOKENS = 2_000_000
LEAST_BUCKETS = 16
THETA = 1.0
_END, _START = np.uint64(0x9D5C0F2B7A1E4D31), np.uint64(0x3B86A1D70C95E2F4)


def _pack(x: np.ndarray) -> bytes:
    """Integers as their number and compressed byte planes: high bytes are mostly zero."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""
    return len(x).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpack(data: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _steps(x: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return _pack(np.diff(x, prepend=0).astype(np.int32))


def _unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.int32), dtype=np.int64)


def _signed(x: np.ndarray) -> bytes:
    """Numbers of both signs, mostly small, with the sign in the lowest bit."""
    return _pack((x << 1) ^ (x >> (8 * x.itemsize - 1)))


def _unsigned(data: bytes, kind) -> np.ndarray:
    x = _unpack(data, np.dtype(kind).str.replace("i", "u"))
    return (x >> 1).view(kind) ^ -(x & 1).view(kind)


def _jumps(x: np.ndarray) -> bytes:
    """Numbers that often ascend by their differences."""
    return _signed(np.diff(x, prepend=0).astype(np.int32))


def _unjumps(data: bytes) -> np.ndarray:
    return np.cumsum(_unsigned(data, np.int32), dtype=np.int64)


def _hashes(x: np.ndarray) -> bytes:
    """Hashes that ascend, or do so in parts, by their differences modulo 2**64."""
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unhashes(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _places(order: np.ndarray, kind) -> np.ndarray:
    """Where each position of ``order`` went."""
    place = np.empty(len(order), kind)
    place[order] = np.arange(len(order), dtype=kind)
    return place


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, most frequent first and single ones as they come, and each one's number there."""
    values, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    several = np.flatnonzero(counts > 1)
    order = np.concatenate([several[np.argsort(-counts[several], kind="stable")], inverse[(counts == 1)[inverse]]])
    return values[order], _places(order, np.int32)[inverse]


def _tokens(tokens: np.ndarray, words: int) -> bytes:
    """Numbers made by ``_distinct``: single words are zeros, as their numbers follow each other."""
    single = np.bincount(tokens, minlength=words) == 1
    return _pack(np.where(single[tokens], 0, tokens + 1).astype(np.int32))


def _untokens(data: bytes, words: int) -> np.ndarray:
    tokens = _unpack(data, np.int32) - 1
    single = np.flatnonzero(tokens < 0)
    tokens[single] = np.arange(words - len(single), words)
    return tokens


def _schema(fields: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<binary>": pa.list_(pa.binary()), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def _batch(rows: list[dict], fields: str) -> pa.RecordBatch:
    schema = _schema(fields)
    return pa.RecordBatch.from_pylist([{name: row.get(name) for name in schema.names} for row in rows], schema)


def _frame(rows: list[dict], fields: str) -> pd.DataFrame:
    out = pd.DataFrame([{name: row.get(name) for name in _schema(fields).names} for row in rows], columns=_schema(fields).names)
    return out.astype({f.split()[0]: "Int64" for f in fields.split(", ") if f.split()[1] in ("int", "long")})


_BLOCKS = "block long, keys array<long>, held array<boolean>, sizes array<int>, words binary, trained binary, tokens binary"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: each holds much."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are hashed in pieces of ``PIECE`` bytes; a block is as many pieces as have ``BLOCK_TOKENS`` tokens together."""
    number, held_back, waiting = TaskContext.get().partitionId() << 24, 0, []

    def block() -> pa.RecordBatch:
        nonlocal number, held_back
        h, sizes, held = (np.concatenate([piece[i] for piece in waiting]) for i in range(3))
        words, tokens = _distinct(h)
        trained = np.bincount(tokens[~np.repeat(held, sizes)], minlength=len(words)).astype(np.int32)
        row = {
            "block": number, "keys": [k for piece in waiting for k in piece[3]], "held": held.tolist(), "sizes": sizes.tolist(),
            "words": words.tobytes(), "trained": _pack(trained), "tokens": _tokens(tokens, len(words)),
        }
        number, held_back = number + 1, 0
        waiting.clear()
        return _batch([row], _BLOCKS)

    for batch in batches:
        for part in cut(batch, "text", PIECE):
            piece = Block(part.column("text"))
            starts, ends, at = piece.words()
            sizes = np.diff(at) + 1
            h = np.full(int(sizes.sum()), _END, np.uint64)
            is_word = np.ones(len(h), bool)
            is_word[np.cumsum(sizes) - 1] = False
            h[is_word] = piece.hashes(starts, ends, lower=True)
            waiting.append((h, sizes, part.column("held").to_numpy(zero_copy_only=False).astype(bool), part.column("key").to_pylist()))
            held_back += len(h)
            if held_back >= BLOCK_TOKENS:
                yield block()
    if waiting:
        yield block()


def _owner(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h) % np.uint64(buckets)).astype(np.int64)


def _arrange(row: dict, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's words and the start of a text in the order in which buckets are asked for them: words, order and buckets."""
    words = np.append(np.frombuffer(row["words"], np.uint64), _START)
    bucket = _owner(words, buckets)
    order = np.lexsort((words, bucket))
    return words[order], order, bucket[order]


class _Layout:
    """A block's tokens and pairs by the ``rank`` of each word, the start of a text last, among what buckets are asked for."""

    def __init__(self, row: dict, rank: np.ndarray):
        self.sizes, self.held = np.array(row["sizes"], np.int64), np.array(row["held"], bool)
        self.token = rank[_untokens(row["tokens"], len(rank) - 1)]
        context = np.empty(len(self.token), np.int64)
        context[1:] = self.token[:-1]
        context[np.cumsum(self.sizes) - self.sizes] = rank[-1]
        self.codes, self.inverse = np.unique(self.token << 32 | context, return_inverse=True)


_ASKED = "bucket int, block long, words binary, trained binary, contexts binary, pair_word binary, pair_context binary, pair_trained binary"


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, order, bucket = _arrange(row, buckets)
            layout, trained = _Layout(row, _places(order, np.int64)), np.append(_unpack(row["trained"], np.int32), np.int32(0))[order]
            pair_trained = np.bincount(layout.inverse[~np.repeat(layout.held, layout.sizes)], minlength=len(layout.codes)).astype(np.int32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            pair_cuts = np.searchsorted(layout.codes, cuts << 32)
            rows = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                w, p = slice(cuts[b], cuts[b + 1]), slice(pair_cuts[b], pair_cuts[b + 1])
                contexts, at = np.unique(layout.codes[p] & 0xFFFFFFFF, return_inverse=True)
                rows.append({
                    "bucket": b, "block": row["block"], "words": _hashes(words[w]), "trained": _pack(trained[w]), "contexts": _hashes(words[contexts]),
                    "pair_word": _steps((layout.codes[p] >> 32) - cuts[b]), "pair_context": _pack(at.astype(np.int32)), "pair_trained": _pack(pair_trained[p]),
                })
            yield _batch(rows, _ASKED)

    return run


_BUCKET = "bucket int, block long, words binary, trained binary, contexts binary, cuts array<long>, pair_word binary, pair_context binary, pair_trained binary"


def _gather(buckets: int):
    """All blocks' wishes of one bucket as its distinct words, contexts and pairs (block null), and per block their numbers."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        parts = [_unhashes(x) for x in group["words"]]
        words, at = np.unique(np.concatenate(parts), return_inverse=True)
        trained = np.bincount(at, np.concatenate([_unpack(x, np.int32) for x in group["trained"]]), len(words)).astype(np.int64)
        offsets = np.cumsum([0, *map(len, parts)])
        own = [_unhashes(x) for x in group["contexts"]]
        contexts, context_at = np.unique(np.concatenate(own), return_inverse=True)
        # Contexts lie by the bucket that has their totals.
        owner = _owner(contexts, buckets)
        order = np.argsort(owner, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        context_at, begins = place[context_at], np.cumsum([0, *map(len, own)])
        codes, lengths = [], []
        for k, (w, c) in enumerate(zip(group["pair_word"], group["pair_context"])):
            codes.append(at[offsets[k] + _unsteps(w)].astype(np.int64) << 32 | context_at[begins[k] + _unpack(c, np.int32)])
            lengths.append(len(codes[-1]))
        pairs, pair_at = np.unique(np.concatenate(codes), return_inverse=True)
        pair_trained = np.bincount(pair_at, np.concatenate([_unpack(x, np.int32) for x in group["pair_trained"]]), len(pairs)).astype(np.int64)
        ends, bucket = np.cumsum([0, *lengths]), int(group["bucket"].iloc[0])
        rows = [{
            "bucket": bucket, "words": _hashes(words), "trained": _pack(trained), "contexts": _hashes(contexts[order]), "cuts": np.searchsorted(owner[order], np.arange(buckets + 1)).tolist(),
            "pair_word": _steps(pairs >> 32), "pair_context": _jumps(pairs & 0xFFFFFFFF), "pair_trained": _pack(pair_trained),
        }]
        for k, block in enumerate(group["block"]):
            mine = slice(offsets[k], offsets[k + 1]), slice(ends[k], ends[k + 1])
            # A block's words and pairs come in the bucket's own order.
            rows.append({"bucket": bucket, "block": int(block), "words": _steps(at[mine[0]]), "pair_word": _steps(pair_at[mine[1]])})
        return _frame(rows, _BUCKET)

    return run


class _Pairs:
    """One bucket's words, contexts and pairs; ``moving`` are the pairs whose tables are drawn."""

    def __init__(self, row: dict):
        self.trained, self.cuts = _unpack(row["trained"], np.int64), np.array(row["cuts"], np.int64)
        self.word, self.context = _unsteps(row["pair_word"]), _unjumps(row["pair_context"])
        self.count = _unpack(row["pair_trained"], np.int64)
        self.moving = np.flatnonzero(self.count > 1)
        # One table for each pair, before any is drawn.
        self.types = np.bincount(self.word, self.count > 0, len(self.trained)).astype(np.int64)


_CLAIMS = "bucket int, source int, contexts binary, types binary, tokens binary"


def _claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a bucket has of other buckets' contexts: distinct words after them, and tokens."""
    for row in _rows(batches):
        pairs, contexts = _Pairs(row), _unhashes(row["contexts"])
        types = np.bincount(pairs.context, pairs.count > 0, len(contexts)).astype(np.int64)
        tokens = np.bincount(pairs.context, pairs.count, len(contexts)).astype(np.int64)
        rows = []
        for b in np.flatnonzero(np.diff(pairs.cuts)).tolist():
            c = slice(pairs.cuts[b], pairs.cuts[b + 1])
            rows.append({"bucket": b, "source": row["bucket"], "contexts": _hashes(contexts[c]), "types": _pack(types[c]), "tokens": _pack(tokens[c])})
        yield _batch(rows, _CLAIMS)


_OWNED = "bucket int, contexts binary, types binary, tokens binary, sources array<int>, places array<binary>"


def _own(group: pd.DataFrame) -> pd.DataFrame:
    """A bucket's contexts with their totals, and where each source's contexts are among them."""
    parts = [_unhashes(x) for x in group["contexts"]]
    contexts, at = np.unique(np.concatenate(parts), return_inverse=True)
    types = np.bincount(at, np.concatenate([_unpack(x, np.int64) for x in group["types"]]), len(contexts)).astype(np.int64)
    tokens = np.bincount(at, np.concatenate([_unpack(x, np.int64) for x in group["tokens"]]), len(contexts)).astype(np.int64)
    ends = np.cumsum([0, *map(len, parts)])
    row = {
        "bucket": int(group["bucket"].iloc[0]), "contexts": _hashes(contexts), "types": _pack(types), "tokens": _pack(tokens),
        "sources": group["source"].astype(int).tolist(), "places": [_steps(at[a:b]) for a, b in zip(ends, ends[1:])],
    }
    return _frame([row], _OWNED)


_REPLIES = "bucket int, owner int, tables binary"


def _reply(sampled: bool, swept: bool):
    """The tables of a bucket's contexts (owner null) if they are a sample's, and for each source those of its own if a sweep follows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row, told = group[group["types"].notna()].iloc[0], group[group["more"].notna()]
        tables, places = _unpack(row["types"], np.int64).copy(), {int(s): _unsteps(p) for s, p in zip(row["sources"], row["places"])}
        for source, more in zip(told["source"], told["more"]):
            # A source names each context once.
            tables[places[int(source)]] += _unpack(more, np.int64)
        mine = int(row["bucket"])
        rows = [{"bucket": mine, "tables": _pack(tables)}] if sampled else []
        return _frame(rows + [{"bucket": s, "owner": mine, "tables": _pack(tables[p])} for s, p in places.items() if swept], _REPLIES)

    return run


def walk(sizes: np.ndarray, tables: np.ndarray, leave: np.ndarray, join: np.ndarray, fresh: np.ndarray, discount: float, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Customers leave and sit down by the restaurant's rule, one of each dish in turn, all dishes side by side.

    ``sizes`` are the tables of all dishes one after the other, ``tables`` how many each
    dish has, ``fresh`` the weight of a new table. In each round a random customer of
    every dish with leavers left goes, then one sits down where joiners are left.
    """
    rounds = np.maximum(leave, join)
    ends = np.cumsum(tables)
    if len(tables) and not (rounds > 0).all():
        # Dishes of few rounds do not wait for those of many: each class by itself.
        kinds = np.where(rounds > 0, np.ceil(np.log2(np.maximum(rounds, 1))), -1).astype(np.int64)
    else:
        kinds = np.ceil(np.log2(np.maximum(rounds, 1))).astype(np.int64) if len(tables) else np.zeros(0, np.int64)
    after, made = tables.copy(), {}
    for kind in np.unique(kinds[kinds >= 0]).tolist():
        d = np.flatnonzero(kinds == kind)
        own = _spans(ends[d] - tables[d], tables[d])
        made[kind] = d, *_walk(sizes[own], tables[d], leave[d], join[d], fresh[d], discount, draw)
        after[d] = made[kind][2]
    out = np.ones(int(after.sum()), np.int64)
    starts = np.cumsum(after) - after
    idle = np.flatnonzero(kinds < 0)
    out[_spans(starts[idle], after[idle])] = sizes[_spans(ends[idle] - tables[idle], tables[idle])]
    for d, flat, held in made.values():
        out[_spans(starts[d], held)] = flat
    return out, after


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _walk(flat, tables, leave, join, fresh, discount, draw):
    room = tables + join
    begins = np.cumsum(room) - room
    sizes = np.zeros(int(room.sum()), np.int64)
    sizes[_spans(begins, tables)] = flat
    used, opened = tables.copy(), tables.copy()
    customers = np.add.reduceat(np.append(sizes, 0), begins) if len(begins) else begins
    customers = np.where(room > 0, customers, 0)
    for turn in range(int(max(leave.max(initial=0), join.max(initial=0)))):
        now = np.flatnonzero((leave > turn) & (customers > 0))
        if len(now):
            sums = np.cumsum(sizes)
            picked = np.searchsorted(sums, sums[begins[now]] - sizes[begins[now]] + draw.integers(0, customers[now]), "right")
            sizes[picked] -= 1
            customers[now] -= 1
            opened[now] -= sizes[picked] == 0
        now = np.flatnonzero(join > turn)
        if len(now):
            weights = np.where(sizes > 0, sizes - discount, 0.0)
            sums = np.cumsum(weights)
            base = np.where(begins[now] > 0, sums[begins[now] - 1], 0.0)
            joined = np.where(customers[now] > 0, customers[now] - discount * opened[now], 0.0)
            spot = draw.random(len(now)) * (joined + fresh[now])
            # Rounding may carry a seat past its dish or onto an emptied table; the dish's own tables bound it.
            place = np.clip(np.searchsorted(sums, base + spot, "right"), begins[now], np.maximum(begins[now] + used[now] - 1, begins[now]))
            new = (spot >= joined) | (sizes[place] == 0)
            place = np.where(new, begins[now] + used[now], place)
            sizes[place] += 1
            customers[now] += 1
            used[now] += new
            opened[now] += new
    return sizes[sizes > 0], opened


def seat(counts: np.ndarray, fresh: np.ndarray, discount: float, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Seat each dish's customers from an empty restaurant; where the sampler starts.

    Up to ``JOINT`` customers come together. More come in rounds that double their number:
    a round's new tables are drawn at its mean chance, the others join by table size.
    """
    few = counts <= JOINT
    sizes, tables = jointly(np.where(few, counts, 0), fresh, discount, draw)
    out: dict[int, np.ndarray] = {}
    for i in np.flatnonzero(~few).tolist():
        n, left = np.ones(1, np.int64), int(counts[i]) - 1
        while left:
            step = min(left, int(n.sum()))
            weight = n - discount
            chance = fresh[i] / (fresh[i] + weight.sum())
            begun = int(draw.binomial(step, chance))
            n = np.concatenate([n + draw.multinomial(step - begun, weight / weight.sum()), np.ones(begun, np.int64)])
            left -= step
        out[i] = n
    if not out:
        return sizes, tables
    old, ends = sizes, np.cumsum(tables)
    after = tables.copy()
    for i, n in out.items():
        after[i] = len(n)
    sizes, starts = np.ones(int(after.sum()), np.int64), np.cumsum(after) - after
    small = np.flatnonzero(few)
    sizes[_spans(starts[small], after[small])] = old[_spans(ends[small] - tables[small], tables[small])]
    for i, n in out.items():
        sizes[starts[i] : starts[i] + len(n)] = n
    return sizes, after


def reseat(sizes: np.ndarray, tables: np.ndarray, counts: np.ndarray, now: np.ndarray, fresh: np.ndarray, discount: float, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One Gibbs sweep over dishes that had ``counts`` customers and have ``now``: those gone leave, new ones come, and every customer changes seats."""
    small, d = np.flatnonzero(now <= JOINT), np.flatnonzero(now > JOINT)
    after, moved = np.zeros(len(now), np.int64), np.zeros(0, np.int64)
    if len(d):
        moved, held = sizes[_spans((np.cumsum(tables) - tables)[d], tables[d])], tables[d]
        if (counts[d] != now[d]).any():
            moved, held = walk(moved, held, np.maximum(counts - now, 0)[d], np.maximum(now - counts, 0)[d], fresh[d], discount, draw)
        moved, after[d] = regroup(moved, held, fresh[d], discount, draw)
    seated, after[small] = jointly(now[small], fresh[small], discount, draw)
    out, begins = np.empty(int(after.sum()), np.int64), np.cumsum(after) - after
    out[_spans(begins[small], after[small])] = seated
    out[_spans(begins[d], after[d])] = moved
    return out, after


@lru_cache(4)
def _law(discount: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of up to ``most`` customers at so many tables: the summed weights of their seatings without that of new tables, and the chances of up to so many at the first one's table."""
    n = np.arange(most + 1)
    ways, choose = np.zeros((most + 1, most + 1)), np.zeros((most + 1, most + 1))
    ways[0, 0] = 1
    choose[:, 0] = 1
    for i in range(most):
        ways[i + 1, 1:] = ways[i, :-1] + np.where(n[1:] <= i, i - discount * n[1:], 0) * ways[i, 1:]
        choose[i + 1, 1:] = choose[i, 1:] + choose[i, :-1]
    alone = np.cumprod(np.append(1.0, n[1:-1] - discount))
    first = np.ones((most + 1, most + 1, most))
    for c in range(1, most + 1):
        # The first customer's table has m of c, the others c - m at one table less.
        weights = np.cumsum((choose[c - 1, :c] * alone[:c])[:, None] * ways[c - 1 :: -1, :-1][:c], axis=0)
        first[c, 1:, :c] = (weights / np.maximum(weights[-1], 1e-300)).T
    return ways, first


def jointly(counts: np.ndarray, fresh: np.ndarray, discount: float, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Seats of all customers of dishes with few, drawn together by the law that moves one by one would come to."""
    ways, first = _law(discount, max(JOINT, int(counts.max(initial=1))))
    tables, made = np.zeros(len(counts), np.int64), []
    for c in np.unique(counts[counts > 0]).tolist():
        d = np.flatnonzero(counts == c)
        weights = np.log(ways[c, 1 : c + 1]) + np.log(fresh[d])[:, None] * np.arange(1, c + 1)
        chances = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
        held = np.minimum((chances <= (draw.random(len(d)) * chances[:, -1])[:, None]).sum(axis=1) + 1, c)
        out, left = np.zeros((len(d), int(held.max())), np.int64), np.full(len(d), c)
        for turn in range(out.shape[1]):
            now = np.flatnonzero(held > turn)
            more = held[now] - turn - 1
            size = (first[left[now], more + 1, :c] <= draw.random(len(now))[:, None]).sum(axis=1) + 1
            out[now, turn] = np.where(more > 0, np.minimum(size, left[now] - more), left[now])
            left[now] -= out[now, turn]
        tables[d] = held
        made.append((d, out[out > 0]))
    sizes, starts = np.empty(int(tables.sum()), np.int64), np.cumsum(tables) - tables
    for d, flat in made:
        sizes[_spans(starts[d], tables[d])] = flat
    return sizes, tables


def regroup(sizes: np.ndarray, tables: np.ndarray, fresh: np.ndarray, discount: float, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Every customer of every dish changes seats, in groups whose seats are drawn together.

    A dish's customers fall into groups at random. A group gets up as a whole and sits
    down as an urn has it, whose weight of a new table grows by the discount with each
    one opened, which makes its seats one draw whatever their order. The rule of
    ``walk`` keeps that weight: a step of Metropolis' makes up for the difference, so
    seats have the same law as one by one. Groups are so many that it rarely refuses.
    """
    ends = np.cumsum(tables)
    customers = np.add.reduceat(sizes, ends - tables)
    newly = customers * (fresh / (customers + fresh)) / URN
    groups = np.clip(np.ceil(np.maximum(np.minimum(fresh, customers) * np.sqrt(2 * discount / fresh), newly)), LEAST_GROUPS, customers).astype(np.int64)
    # Dishes of few tables or groups do not wait for those of many.
    kinds = np.ceil(np.log2(tables) / 2).astype(np.int64) * 64 + np.ceil(np.log2(groups)).astype(np.int64)
    after, made = np.zeros(len(tables), np.int64), []
    for kind in np.unique(kinds).tolist():
        d = np.flatnonzero(kinds == kind)
        seated = np.zeros((len(d), int(tables[d].max())), np.int64)
        seated[np.repeat(np.arange(len(d)), tables[d]), _spans(np.zeros(len(d), np.int64), tables[d])] = sizes[_spans(ends[d] - tables[d], tables[d])]
        seated = _regroup(seated, groups[d], fresh[d], discount, draw)
        after[d] = (seated > 0).sum(axis=1)
        made.append((d, seated[seated > 0]))
    out, starts = np.empty(int(after.sum()), np.int64), np.cumsum(after) - after
    for d, flat in made:
        out[_spans(starts[d], after[d])] = flat
    return out, after


def _regroup(seated, groups, fresh, discount, draw):
    """The tables of some dishes, a dish a line, empty places being zeros."""
    waiting = seated.copy()
    for turn in range(int(groups.max())):
        up = draw.binomial(waiting, np.where(groups > turn, 1 / np.maximum(groups - turn, 1), 0.0)[:, None])
        waiting -= up
        left = seated - up
        chances = draw.standard_gamma(np.column_stack([np.where(left > 0, left - discount, 0.0), fresh]))
        sums = chances.sum(axis=1, keepdims=True)
        # Weights next to nothing may all be drawn as zeros.
        chances[:, -1:] = np.where(sums > 0, chances[:, -1:], 1.0)
        sat = draw.multinomial(up.sum(axis=1), chances / np.where(sums > 0, sums, 1.0))
        begun = _urn(sat[:, -1], fresh, discount, draw)
        opened, closed = (begun > 0).sum(axis=1), ((left == 0) & (up > 0)).sum(axis=1)
        most = int(max(opened.max(), closed.max()))
        grown = np.cumsum(np.log1p(discount * np.arange(-1, most) / fresh[:, None] * (np.arange(-1, most) >= 0)), axis=1)
        line = np.arange(len(seated))
        taken = np.log(1 - draw.random(len(seated))) <= grown[line, closed] - grown[line, opened]
        seated = np.column_stack([np.where(taken[:, None], left + sat[:, :-1], seated), np.where(taken[:, None], begun, 0)])
        waiting = np.column_stack([waiting, np.zeros_like(begun)])
        used = int((seated > 0).sum(axis=1).max())
        if seated.shape[1] > 8 + used + used // 2:
            order = np.argsort(seated == 0, axis=1, kind="stable")[:, :used]
            seated, waiting = np.take_along_axis(seated, order, axis=1), np.take_along_axis(waiting, order, axis=1)
    return seated


def _urn(customers, fresh, discount, draw):
    """Tables of customers in an empty restaurant whose weight of a new table grows by the discount, a dish a line."""
    out, opened = np.zeros((len(customers), int(customers.max())), np.int64), np.zeros(len(customers), np.int64)
    for turn in range(out.shape[1]):
        now = np.flatnonzero(customers > turn)
        spot = draw.random(len(now)) * (fresh[now] + turn) - fresh[now] - discount * opened[now]
        width = int(opened[now].max())
        sums = np.cumsum(np.where(out[now, :width] > 0, out[now, :width] - discount, 0.0), axis=1)
        place = np.where(spot < 0, opened[now], np.minimum((sums <= spot[:, None]).sum(axis=1), opened[now] - 1))
        place = np.maximum(place, 0)
        opened[now] += place == opened[now]
        out[now, place] += 1
    return out[:, : int(opened.max(initial=0))]


_MOVING = "bucket int, cuts array<long>, word binary, context binary, count binary, types binary, trained binary"


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What sweeps need of a bucket and never change."""
    for row in _rows(batches):
        pairs = _Pairs(row)
        m = pairs.moving
        yield _batch([{
            "bucket": row["bucket"], "cuts": row["cuts"], "word": _steps(pairs.word[m]), "context": _jumps(pairs.context[m]), "count": _pack(pairs.count[m]),
            "types": _pack(pairs.types), "trained": row["trained"],
        }], _MOVING)


_STATE = "bucket int, sizes binary, tables binary, customers binary, root_sizes binary, root_tables binary, n_customers long, n_tables long, source int, more binary"


def _sweep(number: int, constants: dict, totals: tuple[int, int] | None):
    """One sweep of a bucket, given its contexts' tables and the root's customers and tables after the last one.

    Besides the bucket's seats (source null) it gives each bucket the tables of its contexts beyond one a pair.
    """
    below, above, v, n = (constants[c] for c in ("below", "above", "v", "n"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row, replies = group[group["word"].notna()].iloc[0].to_dict(), group[group["owner"].notna()]
        if totals is not None:
            row |= group[group["sizes"].notna()].iloc[0][["sizes", "tables", "customers", "root_sizes", "root_tables"]].to_dict()
        draw = np.random.Generator(np.random.PCG64([number, int(row["bucket"])]))
        cuts, word, context, count = np.array(row["cuts"], np.int64), _unsteps(row["word"]), _unjumps(row["context"]), _unpack(row["count"], np.int64)
        per_context = np.zeros(int(cuts[-1]), np.float64)
        for owner, tables in zip(replies["owner"], replies["heard"]):
            per_context[cuts[int(owner)] : cuts[int(owner) + 1]] = _unpack(tables, np.int64)
        types = _unpack(row["types"], np.int64)
        if totals is None:
            base = (_unpack(row["trained"], np.int64) + 1) / (n + v + 1)
        else:
            base = (_unpack(row["customers"], np.int64) - above * _unpack(row["root_tables"], np.int64) + (THETA + above * totals[1]) / (v + 1)) / (THETA + totals[0])
        fresh = (THETA + below * per_context[context]) * base[word]
        if totals is None:
            sizes, tables = seat(count, fresh, below, draw)
        else:
            sizes, tables = _unpack(row["sizes"], np.int64), _unpack(row["tables"], np.int64)
        sizes, tables = reseat(sizes, tables, count, count, fresh, below, draw)
        customers = types + np.bincount(word, tables - 1, len(types)).astype(np.int64)
        fresh = np.full(len(types), (THETA + above * (totals[1] if totals else v)) / (v + 1))
        if totals is None:
            root_sizes, root_tables = seat(customers, fresh, above, draw)
            root_sizes, root_tables = reseat(root_sizes, root_tables, customers, customers, fresh, above, draw)
        else:
            root_sizes, root_tables = reseat(_unpack(row["root_sizes"], np.int64), _unpack(row["root_tables"], np.int64), _unpack(row["customers"], np.int64), customers, fresh, above, draw)
        mine, more = int(row["bucket"]), np.bincount(context, tables - 1, int(cuts[-1])).astype(np.int64)
        seats = {
            "bucket": mine, "sizes": _pack(sizes), "tables": _pack(tables), "customers": _pack(customers), "root_sizes": _pack(root_sizes), "root_tables": _pack(root_tables),
            "n_customers": int(customers.sum()), "n_tables": int(root_tables.sum()),
        }
        return _frame([seats, *({"bucket": b, "source": mine, "more": _pack(more[cuts[b] : cuts[b + 1]])} for b in np.flatnonzero(np.diff(cuts)).tolist())], _STATE)

    return run


_ANSWER = "bucket int, block long, words array<binary>, pairs array<binary>"


def _likeness(samples: int) -> list[int]:
    """Which earlier array of a word's numbers each one differs least from.

    Counts come first, then per sample customers and tables at the root, then totals as a context and their tables per sample.
    """
    return [0, 0, 1, *range(1, 2 * samples - 1), 0, *range(2 * samples + 1, 3 * samples + 1)]


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Per block what it asked for: of words their training count, customers and tables at the root and totals as a context, of pairs customers and tables, each per sample."""
    gathered, sampled = group[group["sample"].isna()], group[group["sample"].notna()]
    row = gathered[gathered["block"].isna()].iloc[0]
    # Of the pairs only their counts are needed here, in half the width.
    hashes, count = _unhashes(row["words"]), _unpack(row["pair_trained"], np.int64).astype(np.int32)
    seats = sampled[sampled["customers"].notna()].sort_values("sample")
    owned, totals = sampled[sampled["owned"].notna()], sampled[sampled["customers"].isna() & sampled["owned"].isna()].sort_values("sample")
    words = [_unpack(row["trained"], np.int64)]
    for c, t in zip(seats["customers"], seats["root_tables"]):
        words += [_unpack(c, np.int64), _unpack(t, np.int64)]
    tables, moving = (count > 0).astype(np.int32) * len(seats), np.flatnonzero(count > 1)
    for t in seats["tables"]:
        tables[moving] += (_unpack(t, np.int64) - 1).astype(np.int32)
    # A word that nothing follows in training is no context and has no totals.
    contexts = _unhashes(owned["owned"].iloc[0]) if len(owned) else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(contexts, hashes), max(0, len(contexts) - 1))
    known = contexts[at] == hashes if len(contexts) else np.zeros(len(hashes), bool)
    per_context = [_unpack(owned["tokens"].iloc[0], np.int64)] + [_unpack(t, np.int64) for t in totals["tables"]] if len(owned) else [np.zeros(1, np.int64)] * (1 + len(seats))
    words += [np.where(known, x[at], 0) for x in per_context]
    rows = []
    for asked in gathered[gathered["block"].notna()].itertuples():
        w, p = _unsteps(asked.words), _unsteps(asked.pair_word)
        mine = [x[w] for x in words]
        told = [_pack(mine[0]), *(_signed(x - mine[k]) for x, k in zip(mine[1:], _likeness(len(seats))[1:]))]
        rows.append({"bucket": int(row["bucket"]), "block": int(asked.block), "words": told, "pairs": [_pack(count[p]), _signed(tables[p] - count[p] * np.int32(len(seats)))]})
    return _frame(rows, _ANSWER)


_SCORES = "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


_PLACED = "block long, keys array<long>, held array<boolean>, sizes array<int>, tokens binary, rank binary"


def _place(buckets: int):
    """Blocks without their words, only where each one's answer lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield _batch([row | {"rank": _pack(_places(_arrange(row, buckets)[1], np.int32))}], _PLACED)

    return run


def _score(constants: dict, totals: list[tuple[int, int]]):
    below, above, v, n = (constants[c] for c in ("below", "above", "v", "n"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row, right = left.iloc[0].to_dict(), right.sort_values("bucket")
        layout = _Layout(row, _unpack(row["rank"], np.int32).astype(np.int64))
        words, pairs = [], []
        for told, (c, t) in zip(right["words"], right["pairs"]):
            mine = [_unpack(told[0], np.int64)]
            for x, k in zip(told[1:], _likeness(len(totals))[1:]):
                mine.append(_unsigned(x, np.int64) + mine[k])
            c = _unpack(c, np.int32)
            words.append(mine)
            pairs.append((c, _unsigned(t, np.int32) + c * np.int32(len(totals))))
        words, (count, tables) = [np.concatenate(x) for x in zip(*words)], (np.concatenate(x) for x in zip(*pairs))
        size, trained, tokens = len(totals), words[0], words[1 + 2 * len(totals)]
        word, context = layout.codes >> 32, layout.codes & 0xFFFFFFFF
        up = np.zeros(len(layout.codes))
        for s, (customers, root) in enumerate(totals):
            p = (words[1 + 2 * s] - above * words[2 + 2 * s] + (THETA + above * root) / (v + 1)) / (THETA + customers)
            up += (THETA + below * words[2 + 2 * size + s][context]) * p[word] / size
        pair = (count - below * tables / size + up) / (THETA + tokens[context])
        c, p = trained[layout.token], pair[layout.inverse]
        starts = np.cumsum(layout.sizes) - layout.sizes
        return pd.DataFrame(
            {
                "key": pd.array([None if x is None or x != x else int(x) for x in row["keys"]], "Int64"),
                "held_out": layout.held, "n_tokens": layout.sizes, "n_known": np.add.reduceat((c > 0).astype(np.int64), starts), "train_tokens": n,
                "base_score": np.add.reduceat(np.log10((c + 1) / (n + (v + 1))), starts), "score": np.add.reduceat(np.log10(p), starts),
            }
        )

    return run


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row; the model learns from rows not held out.

    Scores are base-10 logarithms of a text's probability, its end included;
    ``base_score`` is that of add-one smoothed single words. Null texts count as
    empty, rows repeating a key are scored each, and an empty table gives no rows.
    Keys must be whole numbers.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be a whole number, not {docs.schema[key].dataType.simpleString()}")
    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(f"`{text}`").alias("text"))
    blocks = materialise(source.mapInArrow(_tokenise, _BLOCKS), "blocks")
    every = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-every // BUCKET_TOKENS))

    gathered = materialise(blocks.mapInArrow(_ask(buckets), _ASKED).groupBy("bucket").applyInPandas(_gather(buckets), _BUCKET), "buckets")
    whole = gathered.where("block IS NULL")
    owned = materialise(whole.mapInArrow(_claim, _CLAIMS).groupBy("bucket").applyInPandas(_own, _OWNED), "owned")

    def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            pairs = _Pairs(row)
            rows = [{"a": int((x == 1).sum()), "b": int((x == 2).sum()), "k": k} for k, x in enumerate((pairs.count, pairs.types))]
            yield _batch([*rows, {"a": int((pairs.trained > 0).sum()), "b": int(pairs.trained.sum()), "k": 2}], "k int, a long, b long")

    found = {r["k"]: (r["a"], r["b"]) for r in whole.mapInArrow(ones, "k int, a long, b long").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}

    def discount(once: int, twice: int) -> float:
        return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5

    v, n = found.get(2, (0, 0))
    constants = {"below": discount(*found.get(0, (0, 0))), "above": discount(*found.get(1, (0, 0))), "v": v, "n": n}
    moving = materialise(whole.mapInArrow(_begin, _MOVING), "moving")

    def together(left: DataFrame, right: DataFrame, run, schema: str) -> DataFrame:
        # A bucket is little data and much work: each by itself, whatever partitions would be merged for their size.
        both = left.unionByName(right, allowMissingColumns=True)
        return both.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(run, schema)

    # Only what a step reads is shuffled.
    places, totals, state = owned.select("bucket", "types", "sources", "places"), None, None
    kept, samples = [], owned.select("bucket", F.lit(-1).alias("sample"), F.col("contexts").alias("owned"), "tokens")
    for number in range(BURN_IN + SAMPLES + 1):
        told = state.where("source IS NOT NULL").select("bucket", "source", "more") if number else places.select("bucket", F.lit(0).alias("source"), F.lit(None).cast("binary").alias("more")).where(F.lit(False))
        replies = materialise(together(places, told, _reply(number > BURN_IN, number < BURN_IN + SAMPLES), _REPLIES), "tables")
        seats = state.where("source IS NULL").drop("source", "more") if number else None
        if number > BURN_IN:
            sample = F.lit(number - 1).alias("sample")
            samples = samples.unionByName(seats.select("bucket", sample, "tables", "customers", "root_tables"), allowMissingColumns=True)
            samples = samples.unionByName(replies.where("owner IS NULL").select("bucket", sample, "tables"), allowMissingColumns=True)
        if number < BURN_IN + SAMPLES:
            heard = replies.where("owner IS NOT NULL").select("bucket", "owner", F.col("tables").alias("heard"))
            before = moving.drop("trained").unionByName(seats.drop("n_customers", "n_tables"), allowMissingColumns=True) if number else moving
            state = materialise(together(before, heard, _sweep(number, constants, totals), _STATE), "seats")
            totals = tuple(x or 0 for x in state.agg(F.sum("n_customers"), F.sum("n_tables")).first())
            if number >= BURN_IN:
                kept.append(totals)

    asked = gathered.select("bucket", "block", "words", "trained", F.when(F.col("block").isNotNull(), F.col("pair_word")).alias("pair_word"), "pair_trained")
    answers = together(asked, samples, _answer, _ANSWER)
    placed = blocks.drop("trained").mapInArrow(_place(buckets), _PLACED)
    scored = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(constants, kept), _SCORES)
    return scored.withColumnRenamed("key", key)


def perplexity(scored: DataFrame, column: str = "score") -> DataFrame:
    """Perplexity per token, held-out texts and training texts apart; no row for a side without texts."""
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens")).alias("perplexity"))
