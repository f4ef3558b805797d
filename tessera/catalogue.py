"""The registered queries of the search engine over the table of documents, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize_whitespace, token_table
from .operators.index import TextIndex, build_index
from .operators.search import Search, scan_term
from .operators.sets import difference, intersect, union
from .plans.evaluate import Planner, evaluate
from .plans.query import parse
from .sources.corpus import from_documents

Query = Callable[[SparkSession, str], DataFrame]

#: Queries by name. Each has SQL below.
SEARCHES = {
    "bool_flagship": "(the AND of) NOT la",
    "term_docs": "the",
    "bool_and": "the AND of",
    "bool_or": "la OR und",
    "bool_not": "the NOT of",
    "bool_implicit": "the of and",
    "bool_nested": "(the OR la) AND de NOT und",
    "bool_not_group": "the NOT (of AND la)",
    "unknown_and": "the AND flurbles",
    "unknown_or": "the OR flurbles",
    "phrase_2": '"of the"',
    "phrase_3": '"the and attion"',
    "phrase_repeat": '"the the"',
    "phrase_reversed": '"the of"',
    "near_1": "the NEAR/1 of",
    "near_3": "the NEAR/3 of",
    "near_20": "the NEAR/20 of",
    "onear_1": "the ONEAR/1 of",
    "onear_3": "the ONEAR/3 of",
    "near_phrase": '"of the" NEAR/5 and',
    "near_or": "(the OR la) NEAR/2 de",
    "near_nested": "(of NEAR/1 the) NEAR/3 and",
    "onear_nested": "(of NEAR/1 the) ONEAR/3 and",
    "near_self": "the NEAR/2 the",
    "near_gap_101": "the NEAR/101 of",
    "prefix_docs": "thin*",
    "prefix_near": "thin* NEAR/3 the",
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return build_index(documents(spark, sf_dir))


def searching(query: str, plan: str | None = None) -> Query:
    return lambda spark, sf_dir: evaluate(parse(query), index(spark, sf_dir), plan)


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).stats().select("documents", "terms", "postings", "positions")


def term_df_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the 100 terms in most documents."""
    return index(spark, sf_dir).terms.orderBy(F.desc("df"), "term").limit(100)


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).terms


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).postings.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def postings_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).positions("the", 5).select("doc_id", F.col("position").cast("long").alias("position"))


def prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).first_posting()


def hits_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Search.of(index(spark, sf_dir), "the AND of").top(10)


def hit_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Search.of(index(spark, sf_dir), '"of the" NOT la').occurrences(None)


def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Search.of(index(spark, sf_dir), "the AND of").summary()


def explain_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = Planner(parse('the AND "of and" NOT la'), index(spark, sf_dir)).leaves()
    return spark.createDataFrame(leaves, "leaf string, bound long")


def set_of(op: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = index(spark, sf_dir)
        return op(own.doc_ids("the"), own.doc_ids("of"))

    return run


def naive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_term(documents(spark, sf_dir), "the")


def normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", normalize_whitespace(F.col("text")).alias("normal"))


def tokenize_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of whole texts with positions and byte offsets."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    return token_table(texts).select("doc_id", "term", F.col("position").cast("long").alias("position"), F.col("offset").cast("long").alias("offset"))


def tokenize_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of titles and bodies, positions and byte offsets counted in their own field."""
    docs = documents(spark, sf_dir)
    fields = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "body")))).alias("f")).select("doc_id", "f.field", "f.text")
    return token_table(fields).select("doc_id", "field", "term", F.col("position").cast("long").alias("position"), F.col("offset").cast("long").alias("offset"))


QUERIES: dict[str, Query] = {name: searching(q) for name, q in SEARCHES.items()} | {
    "near_nested_joins": searching(SEARCHES["near_nested"], "B"),
    "phrase_2_joins": searching(SEARCHES["phrase_2"], "B"),
    "index_stats": index_stats,
    "term_df_top": term_df_top,
    "term_frequencies": term_frequencies,
    "postings": postings,
    "postings_nth": postings_nth,
    "prefix_sum": prefix_sum,
    "hits_top10": hits_top10,
    "hit_occurrences": hit_occurrences,
    "search_summary": search_summary,
    "explain_leaves": explain_leaves,
    "set_intersect": set_of(intersect),
    "set_union": set_of(union),
    "set_difference": set_of(difference),
    "naive_scan": naive_scan,
    "normalize_ws": normalize_ws,
    "tokenize_offsets": tokenize_offsets,
    "tokenize_fields": tokenize_fields,
}

# SQL. The word pattern has no look-around here; it splits the given tables in the same way.
SQL_WORD = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]|(?:\p{L}(?:['’]\p{L})*|[0-9](?:[.,][0-9])*|\p{N})+"
TOKENS = f"""with f as (select doc_id, split_part(text, chr(10), 1) title, case when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) else '' end body from documents where text is not null),
k as (select doc_id, regexp_extract_all(title, '{SQL_WORD.replace("'", "''")}') tt, regexp_extract_all(body, '{SQL_WORD.replace("'", "''")}') bt from f),
tok as (select doc_id, lower(u.t) term, u.i - 1 p from k, unnest(tt) with ordinality u(t, i) union all select doc_id, lower(u.t), len(tt) + 100 + u.i - 1 from k, unnest(bt) with ordinality u(t, i))
"""
HAS = "bool_or(term = '{0}')"


def flags(condition: str) -> str:
    """condition: words in braces stand for their presence."""
    import re

    return TOKENS + "select doc_id from tok group by doc_id having " + re.sub(r"\{(\w+)\}", r"bool_or(term = '\1')", condition)


def phrase_sql(words: str) -> str:
    values = ", ".join(f"('{w}', {i})" for i, w in enumerate(words.split()))
    return f"(select doc_id, p - o s, p - o + {len(words.split()) - 1} e from tok join (values {values}) w(term, o) using (term) group by doc_id, p - o having count(distinct o) = {len(words.split())})"


def leaf(condition: str) -> str:
    return f"(select doc_id, p s, p e from tok where {condition})"


def near_sql(left: str, right: str, k: int, ordered: bool = False) -> str:
    one = f"select a.doc_id, a.s, b.e from {left} a join {right} b on a.doc_id = b.doc_id and b.s - a.e between 1 and {k}"
    return "(" + one + ("" if ordered else f" union select a.doc_id, a.s, b.e from {right} a join {left} b on a.doc_id = b.doc_id and b.s - a.e between 1 and {k}") + ")"


def docs_of(extents: str) -> str:
    return TOKENS + f"select distinct doc_id from {extents} x"


THE, OF, AND_, DE = (leaf(f"term = '{w}'") for w in ("the", "of", "and", "de"))
THE_OF = near_sql(OF, THE, 1)
THIN = leaf("starts_with(term, 'thin')")

ORACLES = {
    "bool_flagship": flags("{the} and {of} and not {la}"),
    "term_docs": flags("{the}"),
    "bool_and": flags("{the} and {of}"),
    "bool_or": flags("{la} or {und}"),
    "bool_not": flags("{the} and not {of}"),
    "bool_implicit": flags("{the} and {of} and {and}"),
    "bool_nested": flags("({the} or {la}) and {de} and not {und}"),
    "bool_not_group": flags("{the} and not ({of} and {la})"),
    "unknown_and": flags("{the} and {flurbles}"),
    "unknown_or": flags("{the} or {flurbles}"),
    "phrase_2": docs_of(phrase_sql("of the")),
    "phrase_2_joins": docs_of(phrase_sql("of the")),
    "phrase_3": docs_of(phrase_sql("the and attion")),
    "phrase_repeat": docs_of(phrase_sql("the the")),
    "phrase_reversed": docs_of(phrase_sql("the of")),
    "near_1": docs_of(near_sql(THE, OF, 1)),
    "near_3": docs_of(near_sql(THE, OF, 3)),
    "near_20": docs_of(near_sql(THE, OF, 20)),
    "near_gap_101": docs_of(near_sql(THE, OF, 101)),
    "onear_1": docs_of(near_sql(THE, OF, 1, True)),
    "onear_3": docs_of(near_sql(THE, OF, 3, True)),
    "near_phrase": docs_of(near_sql(phrase_sql("of the"), AND_, 5)),
    "near_or": docs_of(near_sql(leaf("term in ('the', 'la')"), DE, 2)),
    "near_nested": docs_of(near_sql(THE_OF, AND_, 3)),
    "near_nested_joins": docs_of(near_sql(THE_OF, AND_, 3)),
    "onear_nested": docs_of(near_sql(THE_OF, AND_, 3, True)),
    "near_self": docs_of(near_sql(THE, THE, 2)),
    "prefix_docs": docs_of(THIN),
    "prefix_near": docs_of(near_sql(THIN, THE, 3)),
    "index_stats": TOKENS + "select (select count(*) from f) documents, count(distinct term) terms, count(distinct (term, doc_id)) postings, count(*) positions from tok",
    "term_frequencies": TOKENS + "select term, count(distinct doc_id) df, count(*) cf from tok group by term",
    "term_df_top": TOKENS + "select term, count(distinct doc_id) df, count(*) cf from tok group by term order by df desc, term limit 100",
    "postings": TOKENS + "select term, doc_id, count(*) tf, string_agg(cast(p as varchar), ',' order by p) positions from tok group by term, doc_id",
    "postings_nth": TOKENS + "select doc_id, p \"position\" from tok where term = 'the' and doc_id = (select doc_id from tok where term = 'the' group by doc_id order by doc_id limit 1 offset 5)",
    "prefix_sum": TOKENS + ", t as (select term, count(distinct doc_id) df from tok group by term) select term, df, cast(coalesce(sum(df) over (order by term rows between unbounded preceding and 1 preceding), 0) as bigint) \"start\" from t",
    "hits_top10": TOKENS
    + ", h as (select doc_id from tok group by doc_id having bool_or(term = 'the') and bool_or(term = 'of') order by doc_id limit 10) select doc_id, cast(doc_id as varchar) external_id, case when length(title) <= 62 then title else left(title, 61) || '…' end title from h join f using (doc_id)",
    "hit_occurrences": TOKENS
    + f", h as (select distinct doc_id from {phrase_sql('of the')} x where doc_id not in (select doc_id from tok where term = 'la')) select doc_id, term, count(*) n from tok join h using (doc_id) where term in ('of', 'the', 'la') group by doc_id, term",
    "search_summary": TOKENS
    + ", h as (select doc_id from tok group by doc_id having bool_or(term = 'the') and bool_or(term = 'of')) select count(*) hits, (select count(*) from f) documents, round(100 * count(*) / greatest((select count(*) from f), 1), 4) percent from h",
    "explain_leaves": TOKENS
    + ", d as (select term, count(distinct doc_id) df from tok group by term) select term leaf, df bound from d where term in ('the', 'la') union all select '\"of and\"', min(df) from d where term in ('of', 'and')",
    "set_intersect": flags("{the} and {of}"),
    "set_union": flags("{the} or {of}"),
    "set_difference": flags("{the} and not {of}"),
    "naive_scan": flags("{the}"),
    "normalize_ws": r"select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '[ \t\n\f\r]+', ' ', 'g') normal from documents",
    "tokenize_offsets": f"""with g as (select doc_id, regexp_extract_all(text, '{SQL_WORD.replace("'", "''")}') toks, string_split_regex(text, '{SQL_WORD.replace("'", "''")}') gaps from documents where text is not null),
s as (select doc_id, unnest(toks) raw, unnest(gaps[1:len(toks)]) gap, unnest(range(len(toks))) i from g)
select doc_id, lower(raw) term, i "position", cast(sum(strlen(gap) + strlen(raw)) over (partition by doc_id order by i) - strlen(raw) as bigint) "offset" from s""",
    "tokenize_fields": TOKENS
    + f""", g as (select doc_id, u.field, regexp_extract_all(u.text, '{SQL_WORD.replace("'", "''")}') toks, string_split_regex(u.text, '{SQL_WORD.replace("'", "''")}') gaps
from (select doc_id, 'title' field, title text from f union all select doc_id, 'body', body from f) u),
s as (select doc_id, field, unnest(toks) raw, unnest(gaps[1:len(toks)]) gap, unnest(range(len(toks))) i from g)
select doc_id, field, lower(raw) term, i "position", cast(sum(strlen(gap) + strlen(raw)) over (partition by doc_id, field order by i) - strlen(raw) as bigint) "offset" from s""",
}
