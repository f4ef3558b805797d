"""Line dedup by a log-template tree.

DataFrame functions only. A line of at least MIN_TOKENS tokens goes down a tree of fixed depth: by its token
count, then by its first DEPTH tokens, tokens with digits generalised to <*>. In a leaf, a token is constant at its place
if lines of MIN_DOCS texts or more have it there, else a variable field <*>; what is left is the line's template. A template is
similar enough to count when at least CONSTANT of its tokens are constant, and recurs when it stands in MIN_DOCS or more different texts.

Boilerplate is what recurs in documents that are otherwise different: copies of a document also share all their lines,
and they are the work of other operators. So each text has three witnesses, its first, last and longest line; a recurring template is
dropped if under some witness no more than SHARE of its texts agree. Groups of near copies and pages with a common frame agree
whatever else stands in them, so it is dropped also if MIN_DOCS of its texts are mostly their own: at least OWN of
their characters are in lines that count and whose templates don't recur. Near copies have few such lines, however many they are
(a changed line is one only if its count of tokens or one of its first DEPTH changed), and can't outvote the others. All its lines are dropped.

Scale: what is shuffled of lines are hashes. Line texts are shuffled only for lines in leaves that recur, thinned by a bit map
of fixed size. Each text meets its decisions in one join. Every count is over all documents; hot lines are pre-aggregated.

Null texts stay null, texts without dropped lines stay as they are, a text may become empty; rows are never dropped.
Ids may be null or repeat: rows are told apart by 128 bits of hash of their text. All columns stay, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bit_longs, fresh, in_bit_map, table, twin, without

MIN_TOKENS = 3
DEPTH = 3
MIN_DOCS = 5
CONSTANT = 0.7
SHARE = 0.25
OWN = 0.5
FIELD = "<*>"
#: Texts, leaves and templates are each known by two hashes, 128 bits.
DOC, LEAF, TEMPLATE = ("doc", "doc2"), ("leaf", "leaf2"), ("template", "template2")


def form(line: Column) -> Column:
    """A line's tokens with one space between them, those with digits generalised."""
    # Most lines have neither runs of white space nor digits, and finding that out is cheap.
    odd = F.contains(line, F.lit("  "))
    for c in "\t\r\f\x0b":
        odd = odd | F.contains(line, F.lit(c))
    plain = F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", FIELD)).otherwise(plain)


def lines(df: DataFrame, text: str) -> DataFrame:
    """A row for each line that counts: doc (hash of the text), at (line number), form (tokens, fields generalised), leaf, the witnesses, and the characters of the text and of all its lines that count."""
    body = F.col(f"`{text}`")
    # Each of these steps is used more than once, so it is a projection of its own; forms are made inside the generator, once.
    own = df.where(body.isNotNull()).select(F.xxhash64(body).alias("doc"), twin(body).alias("doc2"), F.split(body, "\n", -1).alias("lines"))
    own = own.withColumn("filled", F.filter("lines", lambda x: F.trim(x) != ""))
    longest = F.array_max(F.transform("filled", lambda x: F.named_struct(F.lit("n"), F.char_length(x), F.lit("line"), x)))["line"]
    own = own.select(*DOC, F.xxhash64(F.get("filled", 0)).alias("w0"), F.xxhash64(F.try_element_at("filled", F.lit(-1))).alias("w1"), F.xxhash64(longest).alias("w2"), F.transform("lines", form).alias("forms"))
    # A form has MIN_TOKENS tokens if something is left after the first MIN_TOKENS - 1.
    chars = lambda acc, x: F.named_struct(F.lit("whole"), acc["whole"] + F.char_length(x), F.lit("counted"), acc["counted"] + F.when(F.substring_index(x, " ", MIN_TOKENS - 1) == x, 0).otherwise(F.char_length(x)))
    own = own.withColumn("chars", F.aggregate("forms", F.named_struct(F.lit("whole"), F.lit(0), F.lit("counted"), F.lit(0)), chars))
    own = own.select(*DOC, "w0", "w1", "w2", "chars", F.posexplode("forms").alias("at", "form"))
    tokens = F.char_length("form") - F.char_length(F.replace(F.col("form"), F.lit(" "))) + 1
    counted = own.withColumn("n", tokens).where(F.col("n") >= MIN_TOKENS)
    lead = F.substring_index("form", " ", DEPTH)
    return counted.withColumn("leaf", F.xxhash64("n", lead)).withColumn("leaf2", twin("n", lead))


def templates(forms: DataFrame) -> DataFrame:
    """(leaf, form_hash, template): of each form its template, null if too few tokens are constant."""
    rest = forms.select(*LEAF, "form_hash", "docs", "n", F.posexplode(F.split("form", " ")).alias("at", "token")).where(F.col("at") >= DEPTH)
    constant = rest.where(f"token <> '{FIELD}'").groupBy(*LEAF, "at", "token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS).drop("docs")
    marked = rest.drop("docs").join(constant.withColumn("constant", F.lit(True)), [*LEAF, "at", "token"], "left")
    per_form = marked.groupBy(*LEAF, "form_hash").agg(F.sum(F.when(F.col("constant"), 1).otherwise(0)).alias("k"), F.sort_array(F.collect_list(F.struct("at", F.when(F.col("constant"), F.col("token")).otherwise(F.lit(FIELD)).alias("token")))).alias("tail"))
    of = forms.select(*LEAF, "form_hash", "n", "form").join(per_form, [*LEAF, "form_hash"], "left")
    head = F.split(F.substring_index("form", " ", DEPTH), " ")
    fixed = F.coalesce("k", F.lit(0)) + F.size(F.filter(head, lambda t: t != FIELD))
    whole = [*LEAF, F.col("tail.token")]
    return of.where(fixed >= CONSTANT * F.col("n")).select(*LEAF, "form_hash", F.xxhash64(*whole).alias("template"), twin(*whole).alias("template2"))


def dropped_lines(df: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """(doc, drop): for texts with lines of recurring templates their line numbers."""
    found = lines(df, text)
    leaves = found.select(*LEAF, *DOC).distinct().groupBy(*LEAF).agg(F.count("*").alias("docs")).where(F.col("docs") >= MIN_DOCS).select(*LEAF)
    leaves, _ = scratch.write(leaves)
    thin = found.where(in_bit_map(bit_longs(leaves.select("leaf"), leaves.count()), F.col("leaf"))).withColumn("form_hash", F.xxhash64("form"))
    shared, _ = scratch.write(thin.join(leaves, [*LEAF], "left_semi"))
    forms = shared.groupBy(*LEAF, "form_hash", "n", "form", *DOC).agg(F.lit(1)).groupBy(*LEAF, "form_hash", "n", "form").agg(F.count("*").alias("docs"))
    # Written, so that both sides of the join with all lines are plain exchanges, which can be split where a form is hot.
    of_form, _ = scratch.write(templates(forms))
    named = shared.withColumn("size", F.char_length("form")).drop("form", "n").join(of_form, [*LEAF, "form_hash"])
    # Copies of a text are one text from here on.
    named, _ = scratch.write(named.select(*TEMPLATE, *DOC, "at", "w0", "w1", "w2", "size", "chars").distinct())
    texts = named.groupBy(*TEMPLATE, *DOC, "w0", "w1", "w2").agg(F.lit(1)).select(*TEMPLATE, F.posexplode(F.array("w0", "w1", "w2")).alias("witness", "value"))
    agree = texts.groupBy(*TEMPLATE, "witness", "value").agg(F.count("*").alias("texts"))
    agree = agree.groupBy(*TEMPLATE, "witness").agg(F.max("texts").alias("most"), F.sum("texts").alias("docs"))
    recurring = agree.groupBy(*TEMPLATE).agg(F.min("most").alias("most"), F.max("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS)
    recurring, _ = scratch.write(recurring)
    # Texts that are mostly their own, and the templates that stand in enough of them.
    within = named.join(recurring, [*TEMPLATE], "left_semi").groupBy(*DOC, "chars").agg(F.sum("size").alias("shared"))
    different = within.where(F.col("chars.counted") - F.col("shared") >= OWN * F.col("chars.whole")).select(*DOC)
    apart = named.join(different, [*DOC], "left_semi").select(*TEMPLATE, *DOC).distinct().groupBy(*TEMPLATE).agg(F.count("*").alias("own")).where(F.col("own") >= MIN_DOCS).select(*TEMPLATE)
    boiler, _ = scratch.write(recurring.where(F.col("most") <= SHARE * F.col("docs")).select(*TEMPLATE).union(apart))
    return named.join(boiler, [*TEMPLATE], "left_semi").groupBy(*DOC).agg(F.collect_set("at").alias("drop"))


def drop_boilerplate(df: DataFrame, text: str = "text", counted: bool = False) -> DataFrame:
    """df with the lines of recurring templates gone from its texts; if counted also n_lines and n_dropped (long)."""
    key, key2, drop = fresh(df, "doc", "doc2", "drop")
    body = F.col(f"`{text}`")
    scratch = Scratch(df.sparkSession)
    # Written, so that the join can be split where very many rows have one text.
    decisions, _ = scratch.write(dropped_lines(df, text, scratch))
    decisions = decisions.select(F.col("doc").alias(key), F.col("doc2").alias(key2), F.col("drop").alias(drop))
    joined = df.withColumn(key, F.xxhash64(body)).withColumn(key2, twin(body)).join(decisions, [key, key2], "left")
    kept: Column = F.filter(F.split(body, "\n", -1), lambda line, at: ~F.array_contains(F.col(drop), at))
    out = F.when(F.col(drop).isNull(), body).otherwise(F.array_join(kept, "\n"))
    columns = [out.alias(c) if c == text else F.col(f"`{c}`") for c in (without(df, "n_lines", "n_dropped") if counted else df).columns]
    extra = [F.coalesce(F.size(F.split(body, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped")] if counted else []
    return joined.select(*columns, *extra)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_boilerplate(docs, counted=True)


#: The same in DuckDB: texts stand for themselves instead of hashes.
ORACLE_SQL = r"""
with split as (select distinct text, string_split(text, chr(10)) parts from documents where text is not null),
wit as (select *, list_filter(parts, lambda x: trim(x, ' ') <> '') filled from split),
wits as (select text, parts, filled[1] w0, filled[len(filled)] w1, (select max(length(u.x)) from unnest(filled) u(x)) longest, filled from wit),
raw as (select text, w0, w1, longest, u.line, u.i - 1 nr from wits, unnest(parts) with ordinality u(line, i)),
plain as (select text, w0, w1, longest, nr, trim(regexp_replace(line, '\s+', ' ', 'g'), ' ') form0 from raw),
forms0 as (select text, w0, w1, longest, nr, len(string_split(form0, ' ')) n, list_transform(string_split(form0, ' '), lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) toks from plain),
lin as (select text, w0, w1, longest, nr, n, toks, array_to_string(toks[1:3], ' ') lead from forms0 where n >= 3),
leaves as (select n, lead from lin group by n, lead having count(distinct text) >= 5),
shared as (select lin.* from lin join leaves using (n, lead)),
forms as (select n, lead, toks, count(distinct text) docs from shared group by n, lead, toks),
rest as (select n, lead, toks, docs, u.t, u.i nr from forms, unnest(toks) with ordinality u(t, i) where u.i > 3),
const as (select n, lead, nr, t from rest where t <> '<*>' group by n, lead, nr, t having sum(docs) >= 5),
marked as (select r.n, r.lead, r.toks, r.nr, case when c.t is null then '<*>' else r.t end t, case when c.t is null then 0 else 1 end k from rest r left join const c on r.n = c.n and r.lead = c.lead and r.nr = c.nr and r.t = c.t),
tails as (select n, lead, toks, sum(k) k, string_agg(t, ' ' order by nr) tail from marked group by n, lead, toks),
tmpl as (select f.n, f.lead, f.toks, coalesce(tail, '') tail from forms f left join tails t on f.n = t.n and f.lead = t.lead and f.toks = t.toks
  where coalesce(k, 0) + len(list_filter(f.toks[1:3], lambda x: x <> '<*>')) >= 0.7 * f.n),
named as (select s.n, s.lead, t.tail, s.text, s.nr, s.w0, s.w1, s.longest from shared s join tmpl t on s.n = t.n and s.lead = t.lead and s.toks = t.toks),
longest as (select distinct text, max(line) over (partition by text) w2 from raw where length(line) = longest and trim(line, ' ') <> ''),
per as (select distinct n, lead, tail, text, w0, w1 from named),
agree as (select n, lead, tail, 0 w, w0 v, count(*) c from per group by all union all select n, lead, tail, 1, w1, count(*) from per group by all
  union all select n, lead, tail, 2, w2, count(*) from per join longest using (text) group by all),
most as (select n, lead, tail, w, max(c) most, sum(c) docs from agree group by n, lead, tail, w),
boiler as (select n, lead, tail from most group by n, lead, tail having max(docs) >= 5 and min(most) <= 0.25 * max(docs)),
gone as (select distinct named.text, named.nr from named join boiler using (n, lead, tail)),
kept as (select raw.text, string_agg(line, chr(10) order by nr) out from raw anti join gone using (text, nr) group by raw.text),
cnt as (select text, count(*) c from gone group by text)
select d.doc_id, case when cnt.c is null then d.text else coalesce(kept.out, '') end as text,
  cast(coalesce(len(string_split(d.text, chr(10))), 0) as bigint) n_lines, cast(coalesce(cnt.c, 0) as bigint) n_dropped
from documents d left join kept on d.text = kept.text left join cnt on d.text = cnt.text
"""
