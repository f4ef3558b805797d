"""Commands: index a JSON Lines corpus, search an index, time a file of queries."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import IoError, QueryError, TextSearchError
from .functions.text import format_bytes, format_count, format_duration, rate
from .operators.index import TextIndex, build_index
from .operators.search import Search
from .plans.query import parse, point_at
from .sources.corpus import file_bytes, line_stats, read_jsonl, read_lines, warnings


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="build an index")
    index.add_argument("-i", "--input", required=True)
    index.add_argument("-o", "--output", default="index.tessera")
    index.add_argument("-l", "--limit", type=int)
    search = commands.add_parser("search", help="run one query")
    search.add_argument("query")
    search.add_argument("-i", "--index", default="index.tessera")
    search.add_argument("-n", "--limit", type=int, default=10)
    bench = commands.add_parser("bench", help="time queries, one a line")
    bench.add_argument("-i", "--index", default="index.tessera")
    bench.add_argument("-q", "--queries", help="a file of queries; without it a few made of the index's most frequent terms")
    return top


def index_command(spark: SparkSession, source: str, target: str, limit: int | None) -> str:
    began = time.time()
    docs, bad = read_jsonl(spark, source, limit)
    for line in warnings(bad):
        print(line, file=sys.stderr)
    # Parsed and numbered once; the index reads its documents several times.
    docs.write.mode("overwrite").parquet(f"{target}/documents")
    build_index(spark.read.schema(docs.schema).parquet(f"{target}/documents")).save(target)
    delete(spark, f"{target}/documents")
    took = time.time() - began
    s, read = TextIndex.load(spark, target).stats().first(), line_stats(read_lines(spark, source)).first()
    return (
        f"{format_count(s['documents'])} documents of {format_count(read['lines_read'])} lines ({format_bytes(file_bytes(spark, source))}) in {format_duration(took)}, {format_count(rate(s['documents'], took))} a second\n"
        f"{format_count(s['terms'])} terms, {format_count(s['postings'])} postings, {format_count(s['positions'])} positions, {format_bytes(s['bytes'])}"
    )


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def percentile(times: list[float], p: float) -> float:
    times = sorted(times)
    return times[min(len(times) - 1, int(p / 100 * len(times)))]


def workload(index: TextIndex) -> list[str]:
    """Queries of every kind, made of the terms that most documents hold."""
    top = [r["term"] for r in index.terms.orderBy(F.desc("df"), "term").limit(3).collect()]
    if not top:
        return []
    a, b, c = (top * 3)[:3]
    return [a, f"{a} AND {b}", f"{a} OR {b} OR {c}", f"({a} OR {b}) NOT {c}", f'"{a} {b}"', f"{a} NEAR/5 {b}", f"{a} ONEAR/5 {b}", f"{a}*"]


def query_file(spark: SparkSession, file: str) -> list[str]:
    try:
        return [q for r in spark.read.text(file).collect() if (q := r["value"].strip())]
    except AnalysisException as e:
        raise IoError(file, e.getMessage() or "") from e


def bench_command(spark: SparkSession, index: TextIndex, file: str | None, runs: int = 5) -> str:
    out = []
    for query in query_file(spark, file) if file else workload(index):
        try:
            search, times = Search.of(index, query), []
        except QueryError as e:
            out.append(f"{query}: {e}")
            continue
        for _ in range(runs):
            began = time.time()
            hits = search.doc_ids().count()
            times.append(time.time() - began)
        out.append(f"{query}: {format_count(hits)} hits, " + ", ".join(f"p{p:g} {format_duration(percentile(times, p))}" for p in (50, 90, 99, 99.9)))
    return "\n".join(out)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    try:
        if args.command == "search":
            parse(args.query)  # before Spark starts or a file is opened
        spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
        if args.command == "index":
            print(index_command(spark, args.input, args.output, args.limit))
        else:
            began = time.time()
            index = TextIndex.load(spark, args.index)
            print(f"loaded {format_count(index.documents or 0)} documents, {format_count(index.size or 0)} postings in {format_duration(time.time() - began)}")
            print(Search.of(index, args.query).report(args.limit) if args.command == "search" else bench_command(spark, index, args.queries))
    except TextSearchError as e:
        print(f"error: {e}", file=sys.stderr)
        if isinstance(e, QueryError):
            print(point_at(args.query, e), file=sys.stderr)
        cause = e.__cause__
        while cause:
            print(f"caused by: {str(cause).splitlines()[0] if str(cause) else type(cause).__name__}", file=sys.stderr)
            cause = cause.__cause__
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
