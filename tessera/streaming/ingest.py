"""Incremental indexing: a stream of JSON lines, each micro-batch appended to an index folder.

Batches are idempotent: each writes its own folder by batch id (overwritten when a batch is repeated after a
failure), so that a restart neither loses nor doubles documents. Document ids are the batch id above 32 bits
of the place in the batch: unique and rising, dense only inside a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import DOCS, POSTINGS, TextIndex, build_index, term_table
from ..sources.corpus import dense_ids, lines_of, parse_lines


def append_batch(lines: DataFrame, batch: int, folder: str) -> None:
    good, bad = parse_lines(lines_of(lines.select("value"), f"batch {batch}"))
    docs = dense_ids(good).withColumn("doc_id", F.col("doc_id") + (batch << 32))
    index = build_index(docs)
    index.postings.write.mode("overwrite").parquet(f"{folder}/postings/batch={batch}")
    index.docs.write.mode("overwrite").parquet(f"{folder}/docs/batch={batch}")
    bad.write.mode("overwrite").parquet(f"{folder}/bad/batch={batch}")


def index_stream(spark: SparkSession, source: str, folder: str, once: bool = True) -> StreamingQuery:
    """Indexes files as they come to `source`; with once, what is there now, then stops."""
    lines = spark.readStream.text(source, lineSep="\n")
    writer = lines.writeStream.foreachBatch(lambda df, batch: append_batch(df, batch, folder)).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def load_stream(spark: SparkSession, folder: str) -> TextIndex:
    """The index of all batches so far; terms are counted from the postings."""
    postings = spark.read.schema(POSTINGS).option("recursiveFileLookup", "true").parquet(f"{folder}/postings")
    return TextIndex(postings, term_table(postings), spark.read.schema(DOCS).option("recursiveFileLookup", "true").parquet(f"{folder}/docs"))
