"""Searching: hits in order with titles, how often each word occurs in them, and why."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_duration, percentage, truncate
from ..plans.evaluate import Planner, evaluate
from ..plans.query import Expr, parse
from .index import TextIndex

TITLE_CHARS = 62


@dataclass(frozen=True)
class Search:
    """A parsed query against an index. Everything stays lazy until it is asked for."""

    index: TextIndex
    expr: Expr

    @staticmethod
    def of(index: TextIndex, query: str) -> Search:
        """Parses first: a bad query never touches the index."""
        return Search(index, parse(query))

    def doc_ids(self) -> DataFrame:
        return evaluate(self.expr, self.index)

    def summary(self) -> DataFrame:
        """(hits, documents, percent)"""
        hits = self.doc_ids().agg(F.count("*").alias("hits")).select("hits", F.lit(0).cast("long").alias("documents"))
        whole = self.index.docs.agg(F.count("*").alias("documents")).select(F.lit(0).cast("long").alias("hits"), "documents")
        both = hits.union(whole).agg(F.sum("hits").alias("hits"), F.sum("documents").alias("documents"))
        return both.withColumn("percent", percentage(F.col("hits"), F.col("documents")))

    def top(self, n: int = 10) -> DataFrame:
        """The first n hits (doc_id, external_id, title); a top-k, not a sort of all hits."""
        first = self.doc_ids().orderBy("doc_id").limit(n)
        return self.index.metadata(first).withColumn("title", truncate(F.col("title"), TITLE_CHARS)).orderBy("doc_id")

    def occurrences(self, n: int | None = 10) -> DataFrame:
        """(doc_id, term, n): how often each word of the query stands in the first n hits (all for None)."""
        hits = self.doc_ids() if n is None else self.doc_ids().orderBy("doc_id").limit(n)
        found = self.index.postings.where(F.col("term").isin(self.expr.terms())).select("doc_id", "term", F.col("tf").cast("long").alias("n"))
        return found.join(hits, "doc_id", "left_semi")

    def leaves(self) -> list[tuple[str, int]]:
        return Planner(self.expr, self.index).leaves()

    def report(self, n: int = 10) -> str:
        began = time.time()
        out = [f"query: {self.expr}"]
        if leaves := self.leaves():
            out.append("narrowest first: " + ", ".join(f"{leaf} ({bound:,})" for leaf, bound in leaves))
        s = self.summary().first()
        out.append(f"{s['hits']:,} hits, {s['percent']:.4f} % of {s['documents']:,} documents")
        counts: dict[int, list[str]] = {}
        order = {t: i for i, t in enumerate(self.expr.terms())}
        for r in sorted(self.occurrences(n).collect(), key=lambda r: order[r["term"]]):
            counts.setdefault(r["doc_id"], []).append(f"{r['term']}×{r['n']}")
        for r in self.top(n).collect():
            out.append("  ".join(x for x in (f"  #{r['doc_id']} {r['external_id'] or ''}".rstrip(), r["title"], " ".join(counts.get(r["doc_id"], []))) if x))
        if s["hits"] > n:
            out.append(f"  {s['hits'] - n:,} hits are not shown")
        out.append(f"searched in {format_duration(time.time() - began)}")
        return "\n".join(out)


def scan_term(docs: DataFrame, term: str) -> DataFrame:
    """The same documents as a term query, without an index: a linear scan (the baseline of benchmarks)."""
    from .index import occurrences

    return occurrences(docs).where(F.col("term") == term).select("doc_id").distinct()
