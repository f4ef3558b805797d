"""Personal data: patterns find protected entities, corpus co-occurrence finds terms that give them away.

DataFrame functions only. The base finds e-mail addresses, IP addresses, card and phone numbers in whole
texts. The information-theoretic part follows disclosure by pointwise mutual information: a term t discloses an
entity e by PMI(t; e) / IC(e), where IC(e) = log2(N / n_e) and PMI = log2(N n_te / (n_t n_e)); n counts
documents of the whole corpus, n_te those that hold both, anywhere. 1 means that who
reads t knows e. A pair must come from MIN_TEXTS different texts, so that a copied document proves nothing.
In a document that holds e every t is a span: removed from disclosure REMOVE on, generalised from GENERALISE on.

Scale: base and spans are made row by row. What is shuffled are (document, entity, term) triples of the entities that stand in MIN_TEXTS
texts or more (others can't make a pair), counts of terms, and the texts of documents with entities. Corpus counts of terms come from one pass over all words, which a
bit map of fixed size thins to the candidate terms before any shuffle.

Null texts count as empty. Offsets are code points, ends exclusive. Matches of a kind are leftmost and don't
overlap; matches that fail a kind's rule are dropped. Kinds may overlap each other; term spans overlap no base span.
Ids may be null or repeat: rows are told apart by id and text, equal rows get equal results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bit_longs, in_bit_map, table

#: The kinds' patterns, made linear: a match begins where the last one ended or where no character stands that could extend it to the left.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
LETTERS = r"\p{L}\p{M}"
WORD = rf"[{LETTERS}]+"
MIN_TEXTS = 2
GENERALISE = 0.7
REMOVE = 0.9
#: What stands for spans in sanitised texts.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "general": "[TERM]", "term": ""}
#: Matches in one text from which on they are located in parts.
MANY = 64
NO_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def located(text: Column, gaps: Column, found: Column, kind: str) -> Column:
    """Spans of the matches `found`, between which `gaps` stand."""
    empty = F.array().cast(NO_SPANS)

    def add(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.char_length(pair["gap"])
        end = begin + F.char_length(pair["match"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["match"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def locate(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), empty.alias("spans")), add)

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    # A list that grows is copied at every step: many matches are located in parts of about the root of their number.
    size = F.ceil(F.sqrt(F.size(found))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / size).cast("int")), lambda i: F.slice(pairs, i * size + 1, size))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{NO_SPANS}>").alias("lists"))
    join = lambda acc, done: F.struct(done["at"].alias("at"), F.concat(acc["lists"], F.array(done["spans"])).alias("lists"))
    many = F.aggregate(parts, nothing, lambda acc, part: F.aggregate(F.array(locate(part, acc["at"])), acc, join), lambda acc: F.flatten(acc["lists"]))
    return F.when(F.size(found) > MANY, many).when(F.size(found) > 0, locate(pairs, F.lit(0))["spans"]).otherwise(empty)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def rule(kind: str) -> Callable[[Column], Column]:
    return lambda span: valid(kind, span["value"])


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.char_length(digits(value)).between(13, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.char_length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """df with __spans: base spans by kind, then start."""
    body = F.col(text)
    numbers = F.col("__numbers")
    signs = {"email": (EMAIL, F.contains(body, F.lit("@"))), "ip": (IP, numbers & body.rlike(r"[0-9]\.[0-9]")), "card": (CARD, numbers), "phone": (PHONE, numbers & F.contains(body, F.lit("+")))}
    none = F.array().cast("array<string>")
    out = df.withColumn("__numbers", body.rlike("[0-9]"))
    for kind, (pattern, sign) in signs.items():
        out = out.withColumn(f"__{kind}", F.when(sign, F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, (pattern, _) in signs.items():
        gaps = F.when(F.size(f"__{kind}") > 0, F.split(body, pattern, -1)).otherwise(none)
        spans = located(body, gaps, F.col(f"__{kind}"), kind)
        out = out.withColumn(f"__{kind}", F.filter(spans, rule(kind)))
    return out.withColumn("__spans", F.concat(*(f"__{k}" for k in KINDS))).drop("__numbers", *(f"__{k}" for k in KINDS))


def entity(span: Column) -> Column:
    """The protected value, whatever its spelling."""
    value = F.when(span["kind"].isin("card", "phone"), digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def terms_of(text: Column) -> Column:
    """The different words of a text that are no part of an address or number."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![{LETTERS}@.0-9]){WORD}(?=[.]?(?:[^{LETTERS}@.0-9]|$))"), F.lit(0)))


def disclosed(base: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(key, term, disclosure): terms that give away an entity of their document."""
    scratch = Scratch(base.sparkSession)
    # m: the rows of equal id and text; they all count as documents.
    held = base.where(F.size("__spans") > 0).select("__key", "__hash", F.explode(F.array_distinct(F.transform("__spans", entity))).alias("entity"))
    held, _ = scratch.write(held.groupBy("__key", "__hash", "entity").agg(F.count("*").alias("m")))
    of_entity = held.groupBy("entity").agg(F.sum("m").alias("n_e"), F.count_distinct("__hash").alias("texts")).where(F.col("texts") >= MIN_TEXTS).drop("texts")
    live = held.join(of_entity.select("entity"), "entity", "left_semi")
    terms = base.join(live.select("__key").distinct(), "__key", "left_semi").select("__key", F.explode(terms_of(F.col("__text"))).alias("term"))
    both, _ = scratch.write(terms.join(live, "__key").distinct())
    pairs = both.groupBy("entity", "term", "__hash").agg(F.sum("m").alias("m")).groupBy("entity", "term").agg(F.sum("m").alias("n_te"), F.count("*").alias("texts")).where(F.col("texts") >= MIN_TEXTS)
    # A term stands in no fewer documents than those where it is with any entity: what can't reach the threshold even so goes first.
    with_any = both.select("__key", "term", "m").distinct().groupBy("term").agg(F.sum("m").alias("n_t"))
    n = F.lit(float(max(2, docs.count())))
    reveal = F.log2(n * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.greatest(F.log2(n / F.col("n_e")), F.lit(1e-9))
    pairs, _ = scratch.write(pairs.join(of_entity, "entity").join(with_any, "term").where(reveal >= GENERALISE).select("entity", "term", "n_te", "n_e"))
    # Corpus counts of the candidate terms: words of all texts, thinned before they are shuffled.
    seen = bit_longs(pairs.select(F.xxhash64("term").alias("h")).distinct(), pairs.count())
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text)), rf"[^{LETTERS}]+"))).alias("term"))
    of_term = words.where(in_bit_map(seen, F.xxhash64("term"))).groupBy("term").agg(F.count("*").alias("n_t"))
    known = pairs.join(of_term, "term").select("entity", "term", F.least(reveal, F.lit(1.0)).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    return both.join(known, ["entity", "term"]).groupBy("__key", "term").agg(F.max("disclosure").alias("disclosure"))


def find(df: DataFrame, id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(id, text, spans) for each row of df; unless `whole`, texts of rows without spans are left out (null). spans: structs of kind, start, end, value; the kinds general and term hold disclosing terms."""
    body = F.coalesce(F.col(text), F.lit(""))
    # Rows are known by 128 bits of hash of id and text, texts by as many.
    named = F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.when(F.col(id).isNull(), "?").otherwise(":"), body)
    docs = df.select(F.col(id).alias("__id"), body.alias("__text"), F.unhex(F.md5(named)).alias("__key"))
    spans = base_spans(docs, "__text").select("__id", "__key", "__spans", F.when((F.size("__spans") > 0) | F.lit(whole), F.col("__text")).alias("__text"))
    base, _ = Scratch(df.sparkSession).write(spans.withColumn("__hash", F.unhex(F.md5("__text"))))
    terms = disclosed(base, docs, "__text")
    per_doc = terms.groupBy("__key").agg(
        F.sort_array(F.collect_set(F.when(F.col("disclosure") < REMOVE, F.col("term")))).alias("general"), F.sort_array(F.collect_set(F.when(F.col("disclosure") >= REMOVE, F.col("term")))).alias("term")
    )
    out = base.join(per_doc, "__key", "left")
    for kind in ("general", "term"):
        pattern = F.concat(F.lit(rf"(?iu)(?<![{LETTERS}])(?:"), F.concat_ws("|", F.col(kind)), F.lit(rf")(?![{LETTERS}])"))
        found = F.when(F.size(kind) > 0, F.regexp_extract_all("__text", pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
        out = out.withColumn("__found", found)
        gaps = F.when(F.size("__found") > 0, F.split(F.col("__text"), pattern, F.lit(-1))).otherwise(F.array().cast("array<string>"))
        clear = lambda s: ~F.exists("__spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        out = out.withColumn(f"__{kind}", F.filter(located(F.col("__text"), gaps, F.col("__found"), kind), clear))
    return out.select(F.col("__id").alias(id), F.col("__text").alias("text"), F.concat("__spans", "__general", "__term").alias("spans"))


def sanitise(found: DataFrame) -> DataFrame:
    """What find() returned, with sanitised: the text with marks in place of spans (of overlapping spans the first and longest counts)."""
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    mark = F.create_map(*[x for k, v in MARKS.items() for x in (F.lit(k), F.lit(v))])

    def put(acc: Column, s: Column) -> Column:
        after = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.element_at(mark, s["kind"]))
        return F.when(s["start"] >= acc["at"], F.struct((-s["back"]).alias("at"), after.alias("out"))).otherwise(acc)

    whole = F.aggregate(order, start, put, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    return found.withColumn("sanitised", whole)


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
