"""The positional index: postings, terms and documents as tables; build, read, save, load."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import IndexFormatError, IoError
from ..functions.text import FIELD_GAP, words

#: Document ids that are counted together.
STRETCH = 1 << 16
#: First characters of a term by which the vocabulary is dealt.
LEAD = 3
KIND, VERSION = "tessera-index", 1
POSTINGS = "term string, doc_id bigint, positions array<int>, tf int"
TERMS = "term string, df bigint, cf bigint"
DOCS = "doc_id bigint, external_id string, title string"
MANIFEST = "kind string, version int, documents bigint, terms bigint, postings bigint, positions bigint"


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, term, position): title tokens from 0 on, body tokens FIELD_GAP after the title's. One pass, nothing shuffled."""
    split = docs.select("doc_id", words(F.col("title")).alias("head"), words(F.col("body")).alias("rest"))
    every = split.select("doc_id", F.size("head").alias("titled"), F.posexplode(F.concat("head", "rest")).alias("at", "raw"))
    position = F.col("at") + F.when(F.col("at") >= F.col("titled"), FIELD_GAP).otherwise(0)
    return every.select("doc_id", F.lower("raw").alias("term"), position.cast("int").alias("position"))


@dataclass(frozen=True)
class TextIndex:
    """postings (term, doc_id, positions, tf), terms (term, df, cf), docs (doc_id, external_id, title). A saved index knows its numbers of documents and postings."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    documents: int | None = None
    size: int | None = None

    # Lookups. Terms are stored in lower case; lookups don't change what they are given.

    def posting(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term).select("doc_id", "positions", "tf")

    def doc_ids(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term).select("doc_id")

    def term(self, term: str) -> DataFrame:
        return self.terms.where(F.col("term") == term)

    def document_frequency(self, term: str) -> int:
        row = self.term(term).select("df").first()
        return row["df"] if row else 0

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """One small job for all terms of a query."""
        found = {r["term"]: r["df"] for r in self.terms.where(F.col("term").isin(terms)).select("term", "df").collect()} if terms else {}
        return {t: found.get(t, 0) for t in terms}

    def spreads(self, stems: list[str]) -> dict[str, int]:
        """For each stem the sum of the document frequencies of the terms that begin with it. One aggregation over the terms, whatever their number."""
        if not stems:
            return {}
        any_stem = reduce(or_, [F.col("term").startswith(s) for s in stems])
        row = self.terms.where(any_stem).agg(*[F.coalesce(F.sum(F.when(F.col("term").startswith(s), F.col("df"))), F.lit(0)).alias(f"n{i}") for i, s in enumerate(stems)]).first()
        return dict(zip(stems, row, strict=True))

    def positions(self, term: str, nth: int) -> DataFrame:
        """The positions of a term in its nth document (from 0); no row past the end.

        Documents are counted in stretches of STRETCH ids. Only the counts are summed in one place, and only the stretch that holds the nth is put in order.
        """
        own = self.postings.where(F.col("term") == term).select("doc_id", "positions", F.floor(F.col("doc_id") / STRETCH).alias("stretch"))
        before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        counts = own.groupBy("stretch").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        held = counts.where((F.col("before") <= nth) & (F.col("before") + F.col("n") > nth)).select("stretch", "before")
        order = Window.partitionBy("stretch").orderBy("doc_id")
        numbered = own.join(held, "stretch").withColumn("nth", F.col("before") + F.row_number().over(order) - 1)
        return numbered.where(F.col("nth") == nth).select("doc_id", F.explode("positions").alias("position"))

    def vocabulary(self) -> DataFrame:
        return self.terms.select("term")

    def first_posting(self) -> DataFrame:
        """(term, df, start): where each term's postings would begin in one list by term. A sum of sums: no task sees all terms."""
        # The first characters split the order into many parts; only their totals are summed in one place.
        part = F.substring("term", 1, LEAD)
        totals = self.terms.groupBy(part.alias("part")).agg(F.sum("df").alias("n"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("part").orderBy("term").rowsBetween(Window.unboundedPreceding, -1)
        own = self.terms.withColumn("part", part).join(base, "part")
        return own.select("term", "df", (F.col("base") + F.coalesce(F.sum("df").over(inside), F.lit(0))).alias("start"))

    def metadata(self, ids: DataFrame) -> DataFrame:
        """ids with external_id and title; ids that no document has get the title <unknown> and no external id."""
        known = ids.join(self.docs, "doc_id", "left")
        return known.select("doc_id", "external_id", F.coalesce("title", F.lit("<unknown>")).alias("title"))

    def stats(self) -> DataFrame:
        """documents, terms, postings, positions, and bytes: 4 for each number of the flat form and the terms' own."""
        names = ("documents", "terms", "postings", "positions", "spelled")
        zero = {n: F.lit(0).cast("long").alias(n) for n in names}
        docs = self.docs.agg(F.count("*").alias("documents")).select(F.col("documents"), *[zero[n] for n in names[1:]])
        some = lambda c: F.coalesce(F.sum(c), F.lit(0))
        terms = self.terms.agg(F.count("*").alias("terms"), some("df").alias("postings"), some("cf").alias("positions"), some(F.octet_length("term")).alias("spelled"))
        both = docs.unionByName(terms.select(zero["documents"], *names[1:])).agg(*[F.sum(n).alias(n) for n in names])
        size: Column = 4 * (2 * F.col("postings") + F.col("positions") + F.col("terms")) + F.col("spelled")
        return both.select("documents", "terms", "postings", "positions", size.cast("long").alias("bytes"))

    def save(self, path: str) -> None:
        """Tables sorted by term (so that scans for a term skip row groups) and a manifest with their counts, written last."""
        spark = self.postings.sparkSession
        try:
            self.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
            saved = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
            terms = term_table(saved)
            terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
            self.docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/docs")
            written = TextIndex(saved, spark.read.schema(TERMS).parquet(f"{path}/terms"), spark.read.schema(DOCS).parquet(f"{path}/docs"))
            written.stats().select(F.lit(KIND).alias("kind"), F.lit(VERSION).alias("version"), "documents", "terms", "postings", "positions").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
        except AnalysisException as e:
            raise IoError(path, e.getMessage() or "") from e

    @staticmethod
    def load(spark: SparkSession, path: str, check: bool = True) -> TextIndex:
        """A saved index; with `check` the tables' counts must be the manifest's."""
        try:
            lines = [r["value"] for r in spark.read.text(f"{path}/manifest").take(2)]
            loaded = TextIndex(*(spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("postings", POSTINGS), ("terms", TERMS), ("docs", DOCS))))
        except AnalysisException as e:
            raise IoError(path, e.getMessage() or "") from e
        try:
            manifest = json.loads(lines[0])
        except (IndexError, ValueError) as e:
            raise IndexFormatError("the manifest can't be read") from e
        if manifest.get("kind") != KIND:
            raise IndexFormatError("this is no index")
        if manifest.get("version") != VERSION:
            raise IndexFormatError(f"version {manifest.get('version')} is not {VERSION}")
        if check:
            found = loaded.stats().first().asDict() | {"postings": loaded.postings.count()}
            for name in ("documents", "terms", "postings", "positions"):
                if manifest.get(name) != found[name]:
                    raise IndexFormatError(f"{found[name]} {name} where the manifest has {manifest.get(name)}")
        return replace(loaded, documents=manifest.get("documents"), size=manifest.get("postings"))


def term_table(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


def build_index(docs: DataFrame) -> TextIndex:
    """The index of docs (doc_id, external_id, title, body). Tokens are grouped by document before anything is shuffled, as a document's tokens are in one task."""
    postings = occurrences(docs).groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    postings = postings.withColumn("tf", F.size("positions"))
    return TextIndex(postings, term_table(postings), docs.select("doc_id", "external_id", "title"))
