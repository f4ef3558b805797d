"""The corpus pipeline: each stage calls one operator of tessera.llm and hands its rows on.

Stages take (spark, docs, sf_dir). All but the last return the columns of documents; the last returns each
document's token ids. run() writes the rows of each stage to the shared folder and reads them again, so that a
stage never repeats the work before it.
"""

from __future__ import annotations

from hashlib import sha256

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, table
from tessera.llm.op2_lines import drop_boilerplate
from tessera.llm.op3_mixing import take_copies
from tessera.llm.op4_simhash import drop_near_copies
from tessera.llm.op6_bpe import bpe_round_trip
from tessera.llm.op8_language import drop_unidentified


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return drop_unidentified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; n_chars follows the text."""
    return with_lengths(drop_boilerplate(docs))


def with_lengths(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of unwanted domains go, those of scarce ones repeat."""
    return take_copies(docs, table(spark, sf_dir, "labels"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the hash of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded_sha256", T.StringType())]
    done = bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), path, fields, lambda ids, decoded: (len(ids), ids.tobytes(), sha256(decoded).hexdigest()))
    return done.drop("text")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("mixing", mixing), ("bpe", bpe)]

#: Language models, components and rates have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, _ = scratch.write(docs)
    return docs
