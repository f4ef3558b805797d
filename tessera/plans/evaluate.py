"""From expressions to Spark plans.

Plan A is one scan of the postings of all terms of a query, one shuffle by document, and one filter made from the
expression; phrases and proximity look at arrays of positions. Plan B is relational: each leaf a table of documents or of
extents (start, end), AND a semi join, NOT an anti join, NEAR a join by document with a range condition. Both give the same
documents. A prefix is a range of terms in both: it is never expanded, so it may stand for any number of them.

On a saved index of PLAN_FROM postings or more the planner reads the terms' document frequencies first: unknown required terms end a query
before any scan, and where one required branch is far rarer than the rest, its documents thin the scan. On a smaller one, or one that
isn't saved (where the frequencies would take a pass over the corpus), that costs more than it saves and the order is as written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import TextIndex
from ..operators.sets import difference, intersect, union
from .query import And, Expr, Near, Not, Or, Phrase, Prefix, Span, Term, fold, positional

#: Postings of an index from which on document frequencies are worth a job of their own.
PLAN_FROM = 20_000_000
#: A required branch so many times rarer than the scan thins it.
RARER = 20
#: Deeper nests of NEAR, or more postings under NEAR, go to plan B: its joins spill, arrays don't.
DEEPEST = 2
MOST_POSTINGS = 200_000_000
#: Documents that a leaf may match of which nothing is known.
UNKNOWN = 1 << 62


def boolean(e: Expr) -> tuple[Expr, ...]:
    """The children of AND, OR and NOT; everything else is a leaf of a Boolean query."""
    return e.children() if isinstance(e, (And, Or, Not)) else ()


class Planner:
    """What the driver knows of a query: document frequencies of its terms and prefixes, bounds of its branches."""

    def __init__(self, expr: Expr, index: TextIndex, counted: bool = True):
        self.expr, self.index, self.counted = expr, index, counted
        self.nodes = list(expr.walk())
        for n in self.nodes:
            if isinstance(n, Near):
                for side in n.children():
                    positional(side, Span(0, 0))
        self.terms = sorted(expr.terms())
        self.stems = list(dict.fromkeys(n.stem for n in self.nodes if isinstance(n, Prefix)))
        self.df = index.frequencies(self.terms) if counted else dict.fromkeys(self.terms, UNKNOWN)
        self.wide = index.spreads(self.stems) if counted else dict.fromkeys(self.stems, UNKNOWN)
        self.most = UNKNOWN if index.documents is None else index.documents
        self.bounds: dict[int, int] = {}
        fold(expr, self.note)

    def note(self, e: Expr, *sides: int) -> int:
        """No more documents than this match a node."""
        if isinstance(e, Term):
            n = self.df[e.term]
        elif isinstance(e, Prefix):
            n = self.wide[e.stem]
        elif isinstance(e, Phrase):
            n = min((self.df[t] for t in e.words), default=0)
        else:
            n = sum(sides) if isinstance(e, Or) else sides[0] if isinstance(e, Not) else min(sides)
        self.bounds[id(e)] = n = min(n, self.most)
        return n

    def bound(self, e: Expr) -> int:
        return self.bounds[id(e)]

    def branches(self) -> tuple[list[Expr], list[Expr]]:
        """Required branches, rarest first, and excluded ones; what is excluded is not taken apart."""
        required, excluded, todo = [], [], [self.expr]
        while todo:
            e = todo.pop()
            if isinstance(e, And):
                todo += [e.right, e.left]
            elif isinstance(e, Not):
                todo.append(e.left)
                excluded.append(e.right)
            else:
                required.append(e)
        return sorted(required, key=self.bound), excluded

    def plan(self) -> str:
        nears = [n for n in self.nodes if isinstance(n, Near)]
        deep = fold(self.expr, lambda e, *below: max(below, default=0) + isinstance(e, Near)) > DEEPEST
        return "B" if deep or (self.counted and sum(self.bound(s) for n in nears for s in n.children()) > MOST_POSTINGS) else "A"

    def leaves(self) -> list[tuple[str, int]]:
        """Terms and phrases with their bounds, each once, rarest first; nothing for a query of one leaf."""
        found = {str(n): self.bound(n) for n in self.nodes if isinstance(n, (Term, Phrase))}
        return sorted(found.items(), key=lambda x: x[1]) if len(found) > 1 else []

    def holding(self, leaves: list[Expr]) -> Column:
        """The postings of these leaves: terms that are among some, or in the range of a prefix. Both reach the scan as pushed filters."""
        terms = sorted({t for e in leaves for t in ([e.term] if isinstance(e, Term) else e.words if isinstance(e, Phrase) else [])})
        parts = [F.col("term").isin(terms)] if terms else []
        parts += [F.col("term").startswith(stem) for stem in dict.fromkeys(e.stem for e in leaves if isinstance(e, Prefix))]
        return balanced(or_, parts) if parts else F.lit(False)


def balanced(op: Callable[[Column, Column], Column], parts: list[Column]) -> Column:
    """All parts joined by op, as a tree of little depth."""
    while len(parts) > 1:
        parts = [reduce(op, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def leaves_of(e: Expr) -> list[Expr]:
    return [n for n in e.walk() if not n.children()]


def evaluate(expr: Expr, index: TextIndex, plan: str | None = None, counted: bool | None = None) -> DataFrame:
    """(doc_id) of the documents that satisfy the expression, each once, in no order."""
    planner = Planner(expr, index, counted if counted is not None else (index.size or 0) >= PLAN_FROM)
    required, _ = planner.branches()
    if any(planner.bound(b) == 0 for b in required):
        return index.postings.select("doc_id").where(F.lit(False))
    return (one_scan if (plan or planner.plan()) == "A" else relational)(planner)


# Plan A


def one_scan(planner: Planner) -> DataFrame:
    index, expr = planner.index, planner.expr
    leaves = leaves_of(expr)
    scan = index.postings.where(planner.holding(leaves))
    if isinstance(expr, Term):
        return scan.select("doc_id")
    if all(isinstance(n, (Term, Prefix, Or)) for n in planner.nodes):
        return scan.select("doc_id").distinct()
    required, _ = planner.branches()
    total, rare = sum(planner.df.values()) + sum(planner.wide.values()), required[0]
    if len(required) > 1 and planner.bound(rare) * RARER < total:
        # Every answer is among the documents that hold some leaf of the rarest branch (all words of a phrase are as good as its rarest).
        keys = [Term(min(e.words, key=planner.df.__getitem__)) if isinstance(e, Phrase) and e.words else e for e in leaves_of(rare)]
        scan = scan.join(index.postings.where(planner.holding(keys)).select("doc_id").distinct(), "doc_id", "left_semi")
    placed = {e for n in planner.nodes if isinstance(n, (Near, Phrase)) for leaf in leaves_of(n) for e in (map(Term, leaf.words) if isinstance(leaf, Phrase) else [leaf])}
    # Of each term, and of all terms of a prefix, the presence is one flag and the positions are one array.
    name = {Term(t): f"t{i}" for i, t in enumerate(planner.terms)} | {Prefix(s): f"p{i}" for i, s in enumerate(planner.stems)}
    columns = []
    for e, g in name.items():
        mine = F.col("term") == e.term if isinstance(e, Term) else F.col("term").startswith(e.stem)
        columns.append(F.max(mine).alias(g))
        if e in placed:
            columns.append(F.array_sort(F.flatten(F.collect_list(F.when(mine, F.col("positions"))))).alias(f"{g}_at"))
    if not columns:
        return scan.select("doc_id").where(F.lit(False))
    by_doc = scan.groupBy("doc_id").agg(*columns)
    return by_doc.where(Condition(name, planner.df).holds(expr)).select("doc_id")


class Condition:
    """The filter of an expression over a document's flags and positions."""

    def __init__(self, name: dict[Expr, str], df: dict[str, int]):
        self.name, self.df = name, df

    def at(self, e: Expr) -> Column:
        return F.col(f"{self.name[e]}_at")

    def holds(self, e: Expr) -> Column:
        """Chains of AND and of OR are gathered first, so that they nest no deeper than the logarithm of their length."""
        kind, parts = fold(e, self.test, boolean)
        return balanced(or_ if kind is Or else and_, parts)

    def test(self, e: Expr, *sides: tuple[type, list[Column]]) -> tuple[type, list[Column]]:
        if isinstance(e, (Term, Prefix)):
            return And, [F.col(self.name[e])]
        if isinstance(e, Phrase):
            return And, [F.size(self.starts(e)) > 0]
        if isinstance(e, Near):
            return And, [self.near(e)]
        whole = lambda kind, parts: parts[0] if len(parts) == 1 else balanced(or_ if kind is Or else and_, parts)
        if isinstance(e, Not):
            (kind, parts), right = sides[0], whole(*sides[1])
            return And, [*(parts if kind is And else [whole(kind, parts)]), ~right]
        own = type(e)
        return own, [c for kind, parts in sides for c in (parts if kind is own or len(parts) == 1 else [whole(kind, parts)])]

    def near(self, e: Near) -> Column:
        meets = lambda x, y: F.exists(x, lambda p: F.exists(y, lambda q: (q["s"] - p["e"]).between(1, e.distance)))
        left, right = (self.extents(x) for x in e.children())
        return F.exists(self.sides(left, right), lambda x: meets(x["l"], x["r"]) if e.ordered else meets(x["l"], x["r"]) | meets(x["r"], x["l"]))

    def sides(self, left: Column, right: Column) -> Column:
        """Both operands' extents in an array of one, so that lambdas over it see values and don't evaluate the operands for each element."""
        return F.array(F.struct(left.alias("l"), right.alias("r")))

    def starts(self, e: Phrase) -> Column:
        if not e.words:
            return F.array().cast("array<int>")
        rare = min(range(len(e.words)), key=lambda i: self.df[e.words[i]])
        rest = [(i, w) for i, w in enumerate(e.words) if i != rare]
        begins = F.transform(self.at(Term(e.words[rare])), lambda p: p - rare)
        return F.filter(begins, lambda s: balanced(and_, [s >= 0, *(F.array_contains(self.at(Term(w)), s + i) for i, w in rest)]))

    def extents(self, e: Expr) -> Column:
        return fold(e, self.extent)

    def extent(self, e: Expr, *sides: Column) -> Column:
        span: Callable[[Column, Column], Column] = lambda s, t: F.struct(s.alias("s"), t.alias("e"))
        if isinstance(e, (Term, Prefix)):
            return F.transform(self.at(e), lambda p: span(p, p))
        if isinstance(e, Phrase):
            return F.transform(self.starts(e), lambda s: span(s, s + (len(e.words) - 1)))
        if isinstance(e, Or):
            return F.array_distinct(F.concat(*sides))
        pairs = lambda x, y: F.flatten(F.transform(x, lambda p: F.transform(F.filter(y, lambda q: (q["s"] - p["e"]).between(1, e.distance)), lambda q: span(p["s"], q["e"]))))
        both = F.transform(self.sides(*sides), lambda x: pairs(x["l"], x["r"]) if e.ordered else F.concat(pairs(x["l"], x["r"]), pairs(x["r"], x["l"])))
        return F.array_distinct(F.flatten(both))


# Plan B


def relational(planner: Planner) -> DataFrame:
    required, excluded = planner.branches()
    docs = documents(planner, required[0])
    for branch in required[1:]:
        docs = intersect(docs, documents(planner, branch))
    for branch in excluded:
        docs = difference(docs, documents(planner, branch))
    return docs


def documents(planner: Planner, expr: Expr) -> DataFrame:
    def make(e: Expr, *sides: DataFrame) -> DataFrame:
        if sides:
            return {And: intersect, Or: union, Not: difference}[type(e)](*sides)
        if isinstance(e, (Phrase, Near)):
            return extents(planner, e).select("doc_id").distinct()
        return planner.index.postings.where(planner.holding([e])).select("doc_id").distinct()

    return fold(expr, make, boolean)


def extents(planner: Planner, expr: Expr) -> DataFrame:
    """(doc_id, s, e): where the expression stands, both ends inclusive, each once."""

    def make(e: Expr, *sides: DataFrame) -> DataFrame:
        if isinstance(e, (Term, Prefix)):
            found = planner.index.postings.where(planner.holding([e])).select("doc_id", F.explode("positions").alias("s"))
            return found.withColumn("e", F.col("s"))
        if isinstance(e, Phrase):
            return phrase(planner, e)
        if isinstance(e, Or):
            return union(*sides)
        # One join for both orders: no two extents follow each other both ways, and the pair reaches from the first's start to the last's end.
        follows = lambda x, y: (F.col(f"{y}.s") - F.col(f"{x}.e")).between(1, e.distance)
        meets = follows("a", "b") if e.ordered else follows("a", "b") | follows("b", "a")
        pairs = sides[0].alias("a").join(sides[1].alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & meets)
        return pairs.select("a.doc_id", F.least("a.s", "b.s").alias("s"), F.greatest("a.e", "b.e").alias("e")).distinct()

    return fold(expr, make)


def phrase(planner: Planner, e: Phrase) -> DataFrame:
    hits = planner.index.postings.where(planner.holding([e]))
    if not e.words:
        none = F.lit(0).alias
        return hits.select("doc_id", none("s"), none("e"))
    places = F.create_map(*[x for w in dict.fromkeys(e.words) for x in (F.lit(w), F.array(*[F.lit(i) for i, v in enumerate(e.words) if v == w]))])
    hits = hits.select("doc_id", F.explode("positions").alias("p"), F.element_at(places, F.col("term")).alias("is"))
    starts = hits.select("doc_id", F.explode("is").alias("i"), "p").groupBy("doc_id", (F.col("p") - F.col("i")).alias("s")).agg(F.count("*").alias("n"))
    return starts.where(F.col("n") == len(e.words)).select("doc_id", "s", (F.col("s") + (len(e.words) - 1)).alias("e"))
