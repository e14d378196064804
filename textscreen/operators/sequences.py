"""Token and vector sequences of examples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import sequence, text
from ..session import materialise
from .joins import BROADCAST_BYTES, lookup
from .ordered import assign_idx

MATRIX_CELLS = 4_000_000  # weights that are broadcast at most, 32 MB
TILE = 256
BLOCK_CELLS = 1_000_000  # positions of a block of rows, about
PIECE_CELLS = 2_000_000  # numbers of dense rows that are made at once, 16 MB
HEAD_CELLS = 16_000_000  # numbers of vectors that every task has at hand, 64 MB as floats


def each_position(df: DataFrame, array: Column | str, names: tuple[str, str], *keep: str) -> DataFrame:
    """One row per array element with its position; an empty array gives one row of nulls.

    The outer form matters: for the inner one Spark adds a non-empty filter that
    computes the array a second time.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(*names))


def truncated_tokens(df: DataFrame, length: int, tokeniser: str = "code", func: str = "func") -> DataFrame:
    return df.withColumn("tokens", text.truncate(text.TOKENISERS.get(tokeniser)(F.col(func)), length))


def embed_tokens(df: DataFrame, vocab: DataFrame, row_id: str = "idx", limit: int = BROADCAST_BYTES, counts: DataFrame | None = None) -> DataFrame:
    """One row per token with its vector; the vector is null where the vocabulary lacks the token.

    An example without tokens keeps one row of nulls. ``vocab`` is a stored table, as
    are the ``counts`` of the tokens, ``(token, n)``, if they are known.
    """
    return lookup(each_position(df, "tokens", ("t", "token"), row_id), vocab, "token", "left", limit, counts)


def dense_sequences(
    embedded: DataFrame, length: int, features: int, row_id: str = "idx", truncate: bool = True
) -> DataFrame:
    """Gather each example's vectors into ``x`` of exactly ``length`` by ``features``, zero filled.

    Only the first ``length`` positions are gathered, so a group is bounded.
    ``truncate`` keeps the first ``features`` values of longer vectors.
    """
    vec = text.truncate(F.col("vec"), features) if truncate else F.col("vec")
    within = embedded.filter(F.col("t").isNull() | (F.col("t") < length))
    gathered = within.groupBy(row_id).agg(F.collect_list(F.struct("t", vec.alias("vec"))).alias("_rows"))
    rows = F.array_sort(F.filter("_rows", lambda r: r["t"].isNotNull()))
    zeros = F.array_repeat(F.lit(0.0), features)
    x = F.transform(rows, lambda r: F.coalesce(r["vec"].cast("array<double>"), zeros))
    return gathered.select(row_id, sequence.pad_rows(x, length, features).alias("x"))


def _rank(vectors: pa.Array) -> np.ndarray:
    """Each vector's place in Spark's order: a null number first, NaN last."""
    keys = [[(v is not None, v is not None and v != v, 0.0 if v is None or v != v else v) for v in vec or []] for vec in vectors.to_pylist()]
    made, place = {}, np.zeros(len(keys), np.int64)
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        place[i] = made.setdefault(tuple(keys[i]), len(made))
    return place


def _begins(ids: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; nulls are alike."""
    if pa.types.is_struct(ids.type):
        begins = np.diff(ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int8), prepend=-1) != 0
        for field in ids.flatten():
            begins |= _begins(field)
        return begins
    if pa.types.is_nested(ids.type):
        values = ids.to_pylist()
        return np.array([i == 0 or v != values[i - 1] for i, v in enumerate(values)], bool)
    return np.diff(ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False), prepend=-1) != 0


def _dense_block(vectors: list[pa.RecordBatch], rows: list[pa.RecordBatch], names: list[str], length: int, features: int, together: str | None, head: pa.Table | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a block with the block's vectors, or those of ``head``, at their positions, a piece at a time."""
    if not rows:
        return
    table, matrix = pa.Table.from_batches(rows).combine_chunks(), pa.array([[0.0] * features], pa.list_(pa.float64()))
    cells = pa.concat_arrays(table.column("_cells").chunks)
    sizes = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    t = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place, times = np.full(len(owner), -1), np.ones(len(owner), np.int64)
    if head is not None:
        keys = head.column("_key").combine_chunks()
        used = np.flatnonzero(np.bincount(pc.index_in(pc.list_flatten(cells).unique(), value_set=keys).drop_null(), minlength=len(keys)))
        vectors = [*vectors, *head.take(pa.array(used)).to_batches()]
    if vectors:
        lists = pa.concat_arrays([v.column("_vecs") for v in vectors])
        found = pc.fill_null(pc.index_in(pc.list_flatten(cells), value_set=pa.concat_arrays([v.column("_key") for v in vectors])), -1).to_numpy(zero_copy_only=False)
        known = pc.list_flatten(lists).cast(pa.list_(pa.float64()))
        matrix = pa.concat_arrays([known, matrix])
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # A key with several vectors stands once for each of them.
        times = np.where(found < 0, 1, counts[found])
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        place = np.repeat(np.where(found < 0, -1, (np.cumsum(counts) - counts)[found]), times)
        place = np.where(place < 0, -1, place + within)
        owner, t = np.repeat(owner, times), np.repeat(t, times)
        place = np.where((place >= 0) & known.is_valid().to_numpy(zero_copy_only=False)[place], place, -1)
    if together is not None:
        # Rows that share an id lie side by side.
        begins = _begins(pa.concat_arrays(table.column(together).chunks))
        if not begins.all():
            owner, table = (np.cumsum(begins) - 1)[owner], table.filter(pa.array(begins))
            rank = np.append(_rank(matrix.slice(0, len(matrix) - 1)), -1)
            order = np.lexsort((rank[place], t, owner))
            owner, place = owner[order], place[order]
        t = np.arange(len(owner)) - np.searchsorted(owner, owner)
    grid = np.full(table.num_rows * length, len(matrix) - 1, np.int64)
    inside = (t < length) & (place >= 0)
    grid[owner[inside] * length + t[inside]] = place[inside]
    step = max(1, PIECE_CELLS // (length * features or 1))
    for i in range(0, table.num_rows, step):
        few = table.slice(i, step)
        taken = matrix.take(pa.array(grid[i * length : (i + few.num_rows) * length]))
        x = pa.ListArray.from_arrays(pa.array(np.arange(few.num_rows + 1) * length, pa.int32()), taken)
        yield pa.RecordBatch.from_arrays([*(pa.concat_arrays(few.column(c).chunks) for c in names), x], [*names, "_x"])


def _by_key(pairs: DataFrame) -> DataFrame:
    """``(_key, _vecs)``, all vectors of a key in their order, null ones included."""
    return pairs.groupBy("_key").agg(F.array_sort(F.collect_list("_v")).alias("_v")).select("_key", F.transform("_v", lambda v: v["vec"]).alias("_vecs"))


def _at_hand(asked: DataFrame, pairs: DataFrame, most: int) -> tuple[DataFrame | None, pa.Table | None]:
    """The keys that are asked for most often, and their vectors, at most ``most`` of them; no key that is asked for once."""
    counted = asked.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # Counts are told apart by an eighth of a power of two, so that there are few levels.
    sized = pairs.groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).join(counted, "_key").select("_key", "_size", F.floor(8 * F.log2("_n")).alias("_level"))
    levels = materialise(sized, "levels")
    least, total = None, 0
    for row in levels.groupBy("_level").agg(F.sum("_size").alias("size")).orderBy(F.desc("_level")).collect():
        total += row["size"]
        if total > most:
            break
        least = row["_level"]
    if least is None:
        return None, None
    keys = levels.filter(F.col("_level") >= least).select("_key")
    return keys, _by_key(pairs.join(F.broadcast(keys), "_key", "left_semi")).toArrow()


def dense_by_block(
    rows: DataFrame, cells: Column, vectors: DataFrame, length: int, features: int, blocks: int, out: str, row_id: str, fetched: Column | None = None, together: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """``rows``, or their columns ``keep``, with ``out``: the vectors of the keys in ``cells``, exactly ``length`` positions, zeros where a key has none.

    ``vectors`` is ``(key, vec)``. Rows are dealt to ``blocks`` blocks by ``row_id``. A
    block asks for its distinct keys (``fetched``, if these are not all ``cells``), so a
    vector travels once per block that has its key, not once per row or position, and is
    put in place where the row is. The vectors that are asked for most, ``HEAD_CELLS``
    numbers at most, are broadcast to all tasks instead. ``together`` makes one row of
    all that share an id, their positions merged; a key with several vectors stands once
    for each then.
    """
    spark, columns = rows.sparkSession, rows.columns if keep is None else keep
    names = [f"_c{i}" for i in range(len(columns))]
    block = F.pmod(F.xxhash64(F.col(f"`{row_id}`")), F.lit(blocks)).alias("_block")
    placed = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)], block, cells.alias("_cells"), (cells if fetched is None else fetched).alias("_ask"))
    asked = placed.select("_block", F.explode(F.array_distinct("_ask")).alias("_key"))
    # A struct keeps null vectors.
    pairs = vectors.select(F.col("key").alias("_key"), F.struct("vec").alias("_v"))
    near, head = _at_hand(asked, pairs, HEAD_CELLS // max(1, features))
    shared = None if head is None else spark.sparkContext.broadcast(head)
    if near is not None:
        asked, pairs = (x.join(F.broadcast(near), "_key", "left_anti") for x in (asked, pairs))
    given = asked.distinct().join(_by_key(pairs), "_key").select("_block", F.lit(0).alias("_kind"), "_key", "_vecs")
    both = given.unionByName(placed.drop("_ask").withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    own = names[columns.index(row_id)]
    dealt = both.repartition(blocks, "_block").sortWithinPartitions("_block", "_kind", own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        known = names, length, features, own if together else None, None if shared is None else shared.value
        for batch in batches:
            mark = batch.column("_block").to_numpy() * 2 + batch.column("_kind").to_numpy()
            ends = [*(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
            for a, b in zip([0, *ends], ends):
                at, kind = divmod(int(mark[a]), 2) if b > a else (now, 0)
                if at != now:
                    yield from _dense_block(*held, *known)
                    now, held = at, ([], [])
                held[kind].append(batch.slice(a, b - a))
        yield from _dense_block(*held, *known)

    kinds = T.StructType([*[T.StructField(n, rows.schema[c].dataType) for c, n in zip(columns, names)], T.StructField("_x", T.ArrayType(T.ArrayType(T.DoubleType())))])
    made = dealt.mapInArrow(run, kinds)
    kept = [(c, n) for c, n in zip(columns, names) if c != out]
    return made.select(*[F.col(n).alias(c) for c, n in kept], F.col("_x").alias(out))


def blocks_for(df: DataFrame, cells: int) -> int:
    """How many blocks rows with so many positions make: about ``BLOCK_CELLS`` each, and work for all tasks."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells // BLOCK_CELLS))


def short_vectors(vec: Column, kind: T.DataType, features: int) -> Column:
    """The first ``features`` numbers, as floats where they were floats."""
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    return F.slice(vec if plain else vec.cast("array<double>"), 1, features)


def featurize(
    df: DataFrame, vocab: DataFrame, length: int, features: int, tokeniser: str = "code", row_id: str = "idx"
) -> DataFrame:
    """Text to dense sequences: tokenise, cut, look up, gather, pad; empty texts become all zeros.

    Vectors are cut to ``features`` before they are sent, each once to a block of rows
    that has its token, those of the most frequent tokens to all tasks. Rows that share an id are one, by position.
    """
    # A token has one byte at least, four on average in text and code.
    size = df.agg(F.sum(F.octet_length("func"))).first()[0] or 0
    tokens = truncated_tokens(df, length, tokeniser).select(row_id, "tokens")
    vectors = vocab.select(F.col("token").alias("key"), short_vectors(F.col("vec"), vocab.schema["vec"].dataType, features).alias("vec"))
    made = dense_by_block(tokens, F.col("tokens"), vectors, length, features, blocks_for(df, size // 4), "x", row_id, together=True, keep=[row_id])
    return made.select(row_id, "x")


def to_long(df: DataFrame, x: str = "x", row_id: str = "id") -> DataFrame:
    """``(id, t, f, v)`` rows of dense sequences."""
    rows = each_position(df, x, ("t", "_row"), row_id)
    return each_position(rows, "_row", ("f", "v"), row_id, "t").filter(F.col("f").isNotNull())


def linear(df: DataFrame, weights: DataFrame, bias: DataFrame, vector: str = "vector", out: str = "y", cells: int | None = None, tile: int = TILE) -> DataFrame:
    """Apply ``y = W·x + b`` with ``weights(o, f, w)`` and ``bias(o, b)`` held in tables.

    The layer has the features 0 to the largest ``f`` and one output per row of
    ``bias``, in the order of ``o``; a cell that ``weights`` lacks is 0. ``y`` is
    null unless the vector has one value per feature, none of them null.

    A layer of up to ``cells`` weights, ``MATRIX_CELLS`` by default, travels as one
    broadcast row and every vector is mapped where it is. A larger one is cut into
    tiles of ``tile`` by ``tile`` weights, with the same meaning.
    """
    features, outputs = weights.agg(F.coalesce(F.max("f") + 1, F.lit(0))).first()[0], bias.count()
    whole = F.col(vector).isNotNull() & (F.size(vector) == features) & ~F.exists(vector, lambda v: v.isNull())
    if features * outputs > (MATRIX_CELLS if cells is None else cells):
        return _linear_by_tiles(df, weights, bias, vector, out, whole, features, tile)
    given = weights.groupBy("o").agg(F.map_from_entries(F.collect_list(F.struct("f", "w"))).alias("_cells"))
    dense = F.transform(sequence.indices(F.lit(features)), lambda f: F.coalesce(F.try_element_at("_cells", f.cast(weights.schema["f"].dataType)), F.lit(0.0)))
    rows = bias.join(given, "o", "left").select("o", dense.alias("_w"), "b")
    layer = rows.agg(F.array_sort(F.collect_list(F.struct("o", "_w", "b"))).alias("_layer"))
    matrix = F.transform("_layer", lambda r: r["_w"])
    biases = F.transform("_layer", lambda r: r["b"])
    applied = df.crossJoin(F.broadcast(layer.select(matrix.alias("_matrix"), biases.alias("_bias"))))
    return applied.withColumn(out, F.when(whole, sequence.affine(F.col(vector), F.col("_matrix"), F.col("_bias")))).drop("_matrix", "_bias")


def _linear_by_tiles(df: DataFrame, weights: DataFrame, bias: DataFrame, vector: str, out: str, whole: Column, features: int, tile: int) -> DataFrame:
    """The layer as a tiled matrix product.

    A vector is cut into slices of ``tile`` features. Each slice meets the tiles of
    its features, which are repeated for as many shares of the rows as keep all
    tasks busy, and gives one partial sum per output of the tile. A row therefore
    sends ``features / tile`` values per output through the shuffle instead of
    ``features``, and a task holds a tile and a slice, whatever the layer's size.
    Partial sums are added in the order of the features.
    """
    strips = math.ceil(features / tile)
    shares = max(1, math.ceil(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) / strips))
    marked = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    numbered = assign_idx(bias.select(F.col("o").cast("long").alias("o"), "b"), "o", name="_at")
    outputs = materialise(numbered.select("o", "b", F.expr(f"_at div {tile}").alias("_ot")), "outputs")

    placed = weights.select(F.col("o").cast("long").alias("o"), F.expr(f"f div {tile}").cast("int").alias("_ft"), F.expr(f"f % {tile}").cast("int").alias("_f"), F.col("w").cast("double").alias("w"))
    runs = placed.groupBy("o", "_ft").agg(F.map_from_entries(F.collect_list(F.struct("_f", "w"))).alias("_cells"))
    every = outputs.select("o", "_ot", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("_ft"))
    width = F.least(F.lit(tile), F.lit(features) - F.col("_ft") * tile).cast("int")
    dense = F.transform(sequence.indices(width), lambda f: F.coalesce(F.try_element_at("_cells", f), F.lit(0.0)))
    lines = every.join(runs, ["o", "_ft"], "left").select("_ot", "_ft", "o", dense.alias("_w"))
    tiles = lines.groupBy("_ot", "_ft").agg(F.array_sort(F.collect_list(F.struct("o", "_w"))).alias("_tile"))
    tiles = tiles.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    slices = marked.filter(whole).select("_row", F.col(vector).cast("array<double>").alias("_x"), F.pmod("_row", F.lit(shares)).cast("int").alias("_share"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("_ft"))
    slices = slices.select("_row", "_share", "_ft", F.slice("_x", F.col("_ft") * tile + 1, F.lit(tile)).alias("_x"))
    add = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)
    partial = F.transform("_tile", lambda r: F.aggregate(F.zip_with(r["_w"], F.col("_x"), lambda w, v: w * v), F.lit(0.0), lambda acc, p: acc + p))
    sums = slices.join(tiles.hint("shuffle_hash"), ["_ft", "_share"]).select("_row", "_ot", F.struct("_ft", partial.alias("_p")).alias("_part"))
    gathered = sums.groupBy("_row", "_ot").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    biases = outputs.groupBy("_ot").agg(F.array_sort(F.collect_list(F.struct("o", "b"))).alias("_b"))
    parts = F.transform("_parts", lambda r: r["_p"])
    total = F.aggregate(F.slice(parts, 2, F.lit(strips)), F.get(parts, F.lit(0)), add)
    blocks = lookup(gathered.select("_row", "_ot", total.alias("_s")), materialise(biases, "biases"), "_ot", "inner")
    blocks = blocks.select("_row", F.struct("_ot", add(F.col("_s"), F.transform("_b", lambda r: r["b"].cast("double"))).alias("_y")).alias("_block"))
    whole_rows = blocks.groupBy("_row").agg(F.array_sort(F.collect_list("_block")).alias("_blocks"))
    applied = marked.join(whole_rows, "_row", "left")
    return applied.withColumn(out, F.flatten(F.transform("_blocks", lambda r: r["_y"]))).drop("_row", "_blocks")
