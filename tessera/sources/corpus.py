"""Corpora: JSON Lines with three string fields, lines of any DataFrame, and tables of documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IoError, MalformedRecord
from ..functions.text import normalize_whitespace, trim_space

FIELDS = ("id", "title", "abstract")
RECORD = "external_id string, raw_title string, raw_body string, reason string"
#: Bad records that are named; the rest is one further line.
NAMED = 5
#: File splits whose counts go to the driver and back as a broadcast (at 128 MB each, 100 TB are 800,000).
MOST_BLOCKS = 1_000_000
#: Lines that are numbered together where they must be shuffled.
STRETCH = 1 << 16


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line, value): the lines of a file or folder, numbered from 1 in each file; block is where their split of the file begins."""
    try:
        text = spark.read.text(path, lineSep="\n")
    except AnalysisException as e:
        raise IoError(path, e.getMessage() or "") from e
    placed = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), "value")
    return number_lines(placed)


def small(rows: DataFrame) -> DataFrame:
    """One row for each file split, to be joined with what the splits hold: broadcast if there are MOST_BLOCKS or fewer, so that no line is shuffled."""
    got = rows.limit(MOST_BLOCKS + 1).collect()
    return F.broadcast(rows.sparkSession.createDataFrame(got, rows.schema)) if len(got) <= MOST_BLOCKS else rows


def number_lines(placed: DataFrame) -> DataFrame:
    """(path, block, line, value) of (path, block, mid, value), where mid rises inside each block. Of the lines only counts of blocks are shuffled."""
    blocks = placed.groupBy("path", "block").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = small(blocks.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    return placed.join(blocks, ["path", "block"]).select("path", "block", (F.col("before") + F.col("mid") - F.col("first") + 1).alias("line"), "value")


def lines_of(df: DataFrame, label: str) -> DataFrame:
    """Numbered lines from a DataFrame with column value, as its partitions stand."""
    return number_lines(df.select(F.lit(label).alias("path"), F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("mid"), "value"))


def record(line: str) -> tuple[str | None, str | None, str | None, str | None]:
    """The three fields of a line, or why it isn't a record: no JSON object, trailing text, a field that is missing, twice, no string or no text (half a surrogate pair)."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        names = [k for k, _ in pairs if k in FIELDS]
        if len(names) != len(set(names)):
            raise ValueError(f"duplicate field {next(n for n in names if names.count(n) > 1)}")
        return dict(pairs)

    def strict(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    try:
        got = json.loads(line, object_pairs_hook=once, parse_constant=strict)
    except (ValueError, RecursionError) as e:
        return None, None, None, str(e) or "not JSON"
    if not isinstance(got, dict):
        return None, None, None, "not an object"
    for name in FIELDS:
        if not isinstance(got.get(name), str):
            return None, None, None, f"field {name} is missing or no string"
        if any("\ud800" <= c <= "\udfff" for c in got[name]):
            return None, None, None, f"field {name} holds half a surrogate pair"
    return got["id"], got["title"], got["abstract"], None


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (path, block, line, external_id, title, body) and bad lines (path, line, reason) of numbered lines; blank lines are neither."""
    schema = T.StructType([*lines.schema.fields, *T._parse_datatype_string(RECORD).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(record, batch.column("value").to_pylist()), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in columns)], names=schema.names)

    filled = lines.where(trim_space(F.col("value")) != "")
    parsed = filled.mapInArrow(run, schema)
    good = parsed.where("reason IS NULL").select("path", "block", "line", "external_id", normalize_whitespace(F.col("raw_title")).alias("title"), trim_space(F.col("raw_body")).alias("body"))
    return good, parsed.where("reason IS NOT NULL").select("path", "line", "reason")


def dense_ids(good: DataFrame) -> DataFrame:
    """doc_id 0, 1, 2 ... by path and line. Documents stay where they are: each block's are counted, and only the counts are summed in one place."""
    placed = good.withColumn("mid", F.monotonically_increasing_id())
    counts = placed.groupBy("path", "block").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    got = counts.limit(MOST_BLOCKS + 1).collect()
    if len(got) > MOST_BLOCKS:
        return shuffled_ids(good)
    offsets, before = [], 0
    for r in sorted(got, key=lambda r: (r["path"], r["block"])):
        offsets.append((r["path"], r["block"], before - r["first"]))
        before += r["n"]
    table = F.broadcast(good.sparkSession.createDataFrame(offsets, T.StructType([*counts.schema.fields[:2], T.StructField("offset", T.LongType())])))
    return placed.join(table, ["path", "block"]).select((F.col("offset") + F.col("mid")).alias("doc_id"), "external_id", "title", "body")


def shuffled_ids(good: DataFrame) -> DataFrame:
    """The same where lines may have been shuffled: they are counted in stretches and put in order inside each."""
    placed = good.withColumn("stretch", F.floor(F.col("line") / STRETCH))
    counts = placed.groupBy("path", "stretch").agg(F.count("*").alias("n"))
    before = Window.orderBy("path", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("path", "stretch").orderBy("line")) - 1
    return placed.withColumn("nth", nth).join(offsets, ["path", "stretch"]).select((F.col("before") + F.col("nth")).cast("long").alias("doc_id"), "external_id", "title", "body")


def read_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, external_id, title, body) with dense ids in file order, the first `limit` usable ones; and bad lines."""
    good, bad = parse_lines(read_lines(spark, path))
    docs = dense_ids(good)
    return (docs if limit is None else docs.where(F.col("doc_id") < limit)), bad


def warnings(bad: DataFrame) -> list[str]:
    """The first bad lines by name, and one line for all further ones."""
    rows = bad.orderBy("path", "line").limit(NAMED + 1).collect()
    said = [str(MalformedRecord(r["path"], r["line"], r["reason"])) for r in rows[:NAMED]]
    return said + ([f"and more of them, of which only the first {NAMED} are named"] if len(rows) > NAMED else [])


def line_stats(lines: DataFrame) -> DataFrame:
    """(lines_read, bytes_read): all lines, blank and bad ones too, each with its line feed."""
    return lines.agg(F.count("*").alias("lines_read"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).cast("long").alias("bytes_read"))


def file_bytes(spark: SparkSession, path: str) -> int:
    """The size of a file or of all files of a folder; nothing of them is read."""
    try:
        return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    except AnalysisException as e:
        raise IoError(path, e.getMessage() or "") from e


def from_documents(documents: DataFrame) -> DataFrame:
    """Documents of a table (doc_id, text): the first line is the title, the rest the body."""
    at = F.instr("text", "\n")
    title = F.when(at > 0, F.left("text", at - 1)).otherwise(F.col("text"))
    body = F.when(at > 0, F.substring("text", at + 1, F.length("text"))).otherwise("")
    return documents.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("string").alias("external_id"), title.alias("title"), body.alias("body"))
