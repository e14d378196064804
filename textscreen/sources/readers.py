"""Scans of labelled text and prediction files, with declared schemas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..session import materialise

CANONICAL = StructType(
    [StructField("idx", LongType()), StructField("func", StringType()), StructField("target", IntegerType())]
)
PREDICTIONS = StructType([StructField("idx", LongType()), StructField("y_pred", DoubleType())])
PAIR_PREDICTIONS = StructType([StructField("before", DoubleType()), StructField("after", DoubleType())])

SPREAD_BYTES = 1 << 30
_RANGES = pa.schema([("_file", pa.string()), *((name, pa.int64()) for name in ("_block", "quotes", "even_first", "even_last", "odd_first", "odd_last"))])
SPLIT_IN_NAME = r"([^_/=]+?)(?:[.][A-Za-z0-9]+)*(?:/part-[^/]*)?$"
MODEL_AND_FILE = r"(?:^|/)(?:model=)?([^/=]+)/(?:file=)?([^/=]+?)(?:[.]csv)?(?:/part-[^/]*)?$"
RUN_NAME = r"(?:^|/)([^/]+)_([^_/]+)_on_([^/]+)[.]txt(?:/part-[^/]*)?$"


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header; quoted text may hold commas, quotes and line ends.

    Files whose text spans lines cannot be cut into tasks, so turn
    ``multi_line`` off for plain predictions. Without a schema every column is
    text, by the names in the header.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).csv(path)


def _range_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per byte range its quotes, and its first and last line that starts a record if the parity before it is even or odd."""
    now, odd, marks = None, 0, {}

    def line() -> pa.RecordBatch:
        found = {"_file": now[0], "_block": now[1], "quotes": marks["quotes"]}
        for name, parity in (("even", 0), ("odd", 1)):
            found[f"{name}_first"], found[f"{name}_last"] = marks.get(parity, (None, None))
        return pa.RecordBatch.from_pylist([found], _RANGES)

    for batch in batches:
        files, blocks, seq, quotes = batch.column(0).dictionary_encode(), *(batch.column(i).to_numpy() for i in (1, 2, 3))
        change = (np.diff(files.indices.to_numpy()) != 0) | (np.diff(blocks) != 0)
        ends = [*(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip([0, *ends], ends):
            if a == b:
                continue
            at = files[a].as_py(), int(blocks[a])
            if at != now:
                if now:
                    yield line()
                now, odd, marks = at, 0, {"quotes": 0}
            after = odd + np.cumsum(quotes[a:b])
            before = (after - quotes[a:b]) % 2
            for parity in (0, 1):
                if len(own := np.flatnonzero(before == parity)):
                    marks[parity] = marks.get(parity, (int(seq[a + own[0]]),))[0], int(seq[a + own[-1]])
            marks["quotes"] += int(after[-1] - odd)
            odd = int(after[-1]) % 2
    if now:
        yield line()


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines that begin and end with whole records: their texts, line ends included, but no header."""
    held, header, odd = [], False, 0

    def made(texts: pa.Array, headers: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([texts.filter(pa.array(~headers)).cast(pa.string())], ["_text"])

    for batch in batches:
        lines, quotes, head = batch.column(0).cast(pa.large_string()), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        after = odd + np.cumsum(quotes)
        starts = np.flatnonzero((after - quotes) % 2 == 0)
        odd = int(after[-1]) % 2 if len(after) else odd
        if not len(starts):
            held.append(lines)
            continue
        held.append(lines[: starts[0]])
        if any(len(part) for part in held):
            whole = "".join(line for part in held for line in part.to_pylist())
            yield made(pa.array([whole], pa.large_string()), np.array([header]))
        # The lines of a record lie side by side, so records are other cuts of the same text.
        offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        yield made(pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(offsets[starts]), lines.buffers()[2]), head[starts[:-1]])
        held, header = [lines[starts[-1] :]], bool(head[starts[-1]])
    if any(len(part) for part in held):
        yield made(pa.array(["".join(line for part in held for line in part.to_pylist())], pa.large_string()), np.array([header]))


def read_csv_split(spark: SparkSession, path: str | list[str], schema: StructType | None = None) -> DataFrame:
    """``read_csv`` of text that spans lines, with every file read by many tasks.

    A task reads the lines of its byte range and cannot know whether the first one
    lies inside quotes. So the quotes of every range are counted, the parity before
    each range follows from the ranges before it, and a line starts a record where
    the number of quotes before it is even. Records that lie in one range are put
    together where they are read; only a range's lines before its first and from its
    last start of a record, which may go on in other ranges, are shuffled.

    Quotes inside a quoted value must be doubled, and stand in pairs elsewhere. Each
    file starts with its header. Without a schema every column is text.
    """
    schema = schema or read_csv(spark, path).schema
    text = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = text.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"), quotes.cast("long").alias("_quotes"), "value")

    ranges = materialise(lines.drop("value").mapInArrow(_range_starts, "_file string, _block long, quotes long, even_first long, even_last long, odd_first long, odd_last long"), "counts")
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    even = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 0
    first, last = (F.when(even, F.col(f"even_{which}")).otherwise(F.col(f"odd_{which}")) for which in ("first", "last"))
    ranges = ranges.select("_file", "_block", first.alias("_first"), last.alias("_last"))
    # A record is known by the range and line where it starts; a range's first lines may belong to the last record of the last range that starts one.
    own = F.struct(F.col("_block").alias("block"), F.col("_last").alias("seq"), ((F.col("_block") == 0) & (F.col("_first") == F.col("_last"))).alias("header"))
    opened = F.last(F.when(F.col("_last").isNotNull(), own), ignorenulls=True).over(before)
    ranges = materialise(ranges.select("*", own.alias("_own"), opened.alias("_open")), "ranges")

    known = lines.join(F.broadcast(ranges), ["_file", "_block"], "left")
    # Both scans must cut the files alike; a line without its range would be lost.
    early = F.coalesce(F.col("_seq") < F.col("_first"), F.when(F.col("_own").isNull(), F.raise_error(F.lit("the files were cut into other ranges than counted"))).otherwise(F.lit(True)))
    late = F.col("_seq") >= F.col("_last")
    header = (F.col("_block") == 0) & (F.col("_seq") == F.col("_first"))
    inside = known.filter(~early & ~late).select(F.concat("value", F.lit("\n")).alias("value"), "_quotes", header.alias("_header"))
    # Stored, so that what reads the rows again does not put them together again.
    inner = materialise(inside.mapInArrow(_whole_records, "_text string"), "records")

    edges = known.filter(early | late).select("_file", F.when(early, F.col("_open")).otherwise(F.col("_own")).alias("_home"), F.struct("_block", "_seq", "value").alias("_line"))
    joined = edges.groupBy("_file", "_home").agg(F.array_sort(F.collect_list("_line")).alias("_lines")).filter("NOT _home.header")
    joined = joined.select(F.array_join(F.transform("_lines", lambda line: F.concat(line["value"], F.lit("\n"))), "").alias("_text"))

    record = F.regexp_replace("_text", r"\r?\n\z", "")
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = inner.unionByName(joined).select(record.alias("_text")).filter(F.trim("_text") != "")
    return parsed.select(F.from_csv("_text", ddl, {"escape": '"', "multiLine": "true"}).alias("_row")).select("_row.*")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType = CANONICAL) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _file_path() -> Column:
    """The file's path as it was written; the metadata column gives it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_tree(spark: SparkSession, root: str, schema: StructType = PREDICTIONS, form: str = "csv") -> DataFrame:
    """Every file below ``root`` in one scan, with its path in ``path``."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True)
    files = reader.option("header", True).csv(root) if form == "csv" else reader.json(root)
    return files.select("*", _file_path().alias("path"))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files at ``path``, from their listing; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.sum("length")).first()[0] or 0


def spread(scan: DataFrame, key: str, size: int) -> DataFrame:
    """Use every core for heavy work per row on a scan of only a few row groups.

    A scan is cut at row groups at best, so a small file may end up on one task.
    Files of more than ``SPREAD_BYTES`` together (``size`` is their sum) are left
    as they are: no large table is ever shuffled for this.
    """
    parts = int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scan.repartition(parts, key) if size <= SPREAD_BYTES else scan


def split_from_path(path: Column) -> Column:
    """Last ``_`` part of the file's stem, such as ``train`` in ``set_v1_train.csv``."""
    return F.regexp_extract(path, SPLIT_IN_NAME, 1)


def with_path_dims(df: DataFrame, path: str = "path") -> DataFrame:
    """``model``, ``dataset`` and ``kind`` from ``<model>/<dataset>-<kind>.csv``; no kind gives null."""
    stem = F.regexp_extract(path, MODEL_AND_FILE, 2)
    kind = F.nullif(F.regexp_extract(stem, r"-(safe|vuln)$", 1), F.lit(""))
    return df.withColumns(
        {
            "model": F.regexp_extract(path, MODEL_AND_FILE, 1),
            "dataset": F.regexp_replace(stem, r"-(safe|vuln)$", ""),
            "kind": kind,
        }
    )


def with_run_dims(df: DataFrame, name: str = "name") -> DataFrame:
    """``model``, ``trained_on`` and ``tested_on`` from a name or path ``[model]_[train]_on_[test].txt``."""
    parts = {"model": 1, "trained_on": 2, "tested_on": 3}
    return df.withColumns({out: F.regexp_extract(name, RUN_NAME, group) for out, group in parts.items()})


def read_prediction_lines(spark: SparkSession, path: str) -> DataFrame:
    """``idx<TAB>probability`` text files, one or a folder of them, each with its path."""
    lines = spark.read.schema(PREDICTIONS).option("sep", "\t").option("recursiveFileLookup", True).csv(path)
    return lines.select("*", _file_path().alias("path"))
