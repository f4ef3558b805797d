"""Helpers shared by the training-data operators: fresh names, Arrow maps, scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one call of a vectorised Python step sees at most (a longer single text comes alone).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that start as given and clash with none in df (in any letter case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        got = f"__{name}"
        while got.lower() in have:
            got += "_"
        have.add(got.lower())
        out.append(got)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold at most `limit` bytes, or one row."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def map_texts(df: DataFrame, column: str, added: list[T.StructField], step: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """df with the columns `added`, which step makes from runs of rows of the text column.

    Rows go through Arrow batch by batch, nothing is shuffled. Columns of df that have
    the names of added ones are replaced (the text column itself must not be among them).
    """
    kept = without(df, *(f.name for f in added))
    schema = T.StructType([*kept.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                new = step(part.column(column))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *(f.name for f in added)])

    return kept.mapInArrow(run, schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; where none is set and everything runs on one machine (tests), a temporary one.

    On a cluster without one this is an error: a machine's own folder would hold a part of each table.
    """
    own = spark.sparkContext.getCheckpointDir()
    got = spark.conf.get("spark.checkpoint.dir", None) or own
    if not got:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(got)
        got = spark.sparkContext.getCheckpointDir()
    return got


class Scratch:
    """Tables written to the shared checkpoint folder: cut lineage that survives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.count = 0
        # Results are lazy and may read these tables until the driver ends.
        atexit.register(self.close)

    def close(self) -> None:
        """Deletes all tables; does nothing once the session has stopped."""
        with contextlib.suppress(Exception):
            self.drop(self.root)

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.mode("overwrite").option("compression", "snappy").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Bits of a map that thins rows before they are shuffled: BITS_PER_KEY for each key, between these bounds (2 MB at most). More keys only make it thin less; the exact join follows.
MAP_BITS = (1 << 20, 1 << 24)
BITS_PER_KEY = 8


def bit_longs(hashes: DataFrame, keys: int = 0) -> list[int]:
    """Longs with the bit of each hash (the only column) set; keys: how many there are, about. The driver gets one row for each long at most."""
    (name,) = hashes.columns
    bits = min(MAP_BITS[1], max(MAP_BITS[0], 1 << (BITS_PER_KEY * keys - 1).bit_length()))
    bit = F.pmod(F.col(f"`{name}`"), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))
    rows = hashes.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("at")).agg(F.bit_or(one).alias("bits")).collect()
    longs = [0] * (bits // 64)
    for r in rows:
        if r["at"] is not None:
            longs[r["at"]] = r["bits"]
    return longs


def in_bit_map(longs: list[int], hashed: Column) -> Column:
    """Whether the bit of a hash is set; nothing is when the map is empty."""
    if not any(longs):
        return F.lit(False)
    seen = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")
    bit = F.pmod(hashed, F.lit(64 * len(longs)))
    return F.call_function("shiftright", F.element_at(seen, (F.floor(bit / 64) + 1).cast("int")), (bit % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


def twin(*columns: Column | str) -> Column:
    """A second 64-bit hash, of another seed than xxhash64(*columns), so that both together are 128 bits."""
    return F.xxhash64(F.lit("twin"), *columns)
