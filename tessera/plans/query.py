"""The query language: lexemes, expressions, a parser, errors that point at bytes.

    or      := and ( OR and )*
    and     := near ( (AND | NOT | operand right beside) near )*      left to right
    near    := primary ( (NEAR/k | ONEAR/k) primary )*                left to right
    primary := term | prefix* | "phrase" | ( or )
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import TypeVar

from ..errors import QueryError
from ..functions.text import tokenize

# Characters of the Unicode property White_Space, and those that open and close phrases.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
QUOTES = "\"'\u2019"
MAX_DISTANCE = 2**32 - 1


@dataclass(frozen=True)
class Span:
    """Bytes from start up to end of a query."""

    start: int
    end: int

    def __str__(self) -> str:
        return f"{self.start}..{self.end}"

    def to(self, other: Span) -> Span:
        return Span(self.start, other.end)


@dataclass(frozen=True)
class Lexeme:
    kind: str  # term prefix phrase and or not near ( )
    span: Span
    terms: tuple[str, ...] = ()
    distance: int = 0
    ordered: bool = False

    def __str__(self) -> str:
        if self.kind == "near":
            return f"{'O' * self.ordered}NEAR/{self.distance}"
        return {"term": lambda: self.terms[0], "prefix": lambda: self.terms[0] + "*", "phrase": lambda: f'"{" ".join(self.terms)}"'}.get(self.kind, lambda: self.kind.upper())()


@dataclass(frozen=True, eq=False, repr=False)
class Expr:
    """A node of a query. Nothing here recurses, so trees may be as deep as they like."""

    def children(self) -> tuple[Expr, ...]:
        return ()

    def walk(self) -> Iterator[Expr]:
        """This node, then all below, left to right."""
        stack: list[Expr] = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += reversed(node.children())

    def size(self) -> int:
        return sum(1 for _ in self.walk())

    def is_positional(self) -> bool:
        return True

    def terms(self) -> list[str]:
        """The words of the query in order, each once."""
        found: dict[str, None] = {}
        for node in self.walk():
            for t in (node.term,) if isinstance(node, Term) else node.words if isinstance(node, Phrase) else ():
                found[t] = None
        return list(found)

    def own(self) -> tuple:
        """What a node holds besides its children."""
        return ()

    def spelled(self, *sides: str) -> str:
        raise NotImplementedError

    def __str__(self) -> str:
        return fold(self, lambda node, *sides: node.spelled(*sides))

    def __repr__(self) -> str:
        return f"{type(self).__name__}<{self}>"

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Expr):
            return NotImplemented
        # As each kind of node has a fixed number of children, the nodes in order make the tree.
        mine, theirs = ([(type(n), n.own()) for n in e.walk()] for e in (self, other))
        return mine == theirs

    def __hash__(self) -> int:
        return hash(tuple((type(n).__name__, n.own()) for n in self.walk()))


R = TypeVar("R")


def fold(expr: Expr, make: Callable[..., R], children: Callable[[Expr], tuple[Expr, ...]] = lambda e: e.children()) -> R:
    """make(node, *results of its children), from the leaves up."""
    done: list[R] = []
    todo: list[tuple[Expr, int]] = [(expr, -1)]
    while todo:
        node, held = todo.pop()
        if held < 0:
            below = children(node)
            todo.append((node, len(below)))
            todo += [(c, -1) for c in reversed(below)]
        else:
            sides = done[len(done) - held :]
            del done[len(done) - held :]
            done.append(make(node, *sides))
    return done[0]


@dataclass(frozen=True, eq=False, repr=False)
class Term(Expr):
    term: str

    def own(self) -> tuple:
        return (self.term,)

    def spelled(self, *sides: str) -> str:
        return self.term


@dataclass(frozen=True, eq=False, repr=False)
class Prefix(Expr):
    stem: str

    def own(self) -> tuple:
        return (self.stem,)

    def spelled(self, *sides: str) -> str:
        return f"{self.stem}*"


@dataclass(frozen=True, eq=False, repr=False)
class Phrase(Expr):
    words: tuple[str, ...]

    def own(self) -> tuple:
        return self.words

    def spelled(self, *sides: str) -> str:
        return f'"{" ".join(self.words)}"'


@dataclass(frozen=True, eq=False, repr=False)
class Pair(Expr):
    left: Expr
    right: Expr
    positional: bool = field(init=False, default=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "positional", isinstance(self, (Near, Or)) and self.left.is_positional() and self.right.is_positional())

    def children(self) -> tuple[Expr, ...]:
        return self.left, self.right

    def is_positional(self) -> bool:
        return self.positional

    def spelled(self, *sides: str) -> str:
        return f"({sides[0]} {type(self).__name__.upper()} {sides[1]})"


@dataclass(frozen=True, eq=False, repr=False)
class Near(Pair):
    distance: int = 1
    ordered: bool = False

    def own(self) -> tuple:
        return self.distance, self.ordered

    def spelled(self, *sides: str) -> str:
        return f"({sides[0]} {'O' * self.ordered}NEAR/{self.distance} {sides[1]})"


class And(Pair):
    pass


class Or(Pair):
    pass


class Not(Pair):
    pass


def fail(span: Span, message: str) -> QueryError:
    return QueryError(span.start, span.end - span.start, message)


def lex(query: str) -> list[Lexeme]:
    at_byte = [0]
    for c in query:
        at_byte.append(at_byte[-1] + len(c.encode("utf-8", "surrogatepass")))
    span = lambda a, b: Span(at_byte[a], at_byte[b])
    out, i = [], 0
    while i < len(query):
        c = query[i]
        if c in WHITE:
            i += 1
        elif c in "()":
            out.append(Lexeme(c, span(i, i + 1)))
            i += 1
        elif c in QUOTES:
            close = query.find(c, i + 1)
            if close < 0:
                raise fail(span(i, len(query)), "this phrase is never closed")
            terms = tuple(t.normalized for t in tokenize(query[i + 1 : close]))
            whole = span(i, close + 1)
            if not terms:
                raise fail(whole, "this phrase holds nothing to search for")
            out.append(Lexeme("term" if len(terms) == 1 else "phrase", whole, terms))
            i = close + 1
        else:
            end = i
            while end < len(query) and query[end] not in WHITE and query[end] not in '()"':
                end += 1
            out.append(word(query[i:end], span(i, end)))
            i = end
    return out


def word(text: str, span: Span) -> Lexeme:
    if text in ("AND", "OR", "NOT"):
        return Lexeme(text.lower(), span)
    if text in ("NEAR", "ONEAR"):
        raise fail(span, f"{text} needs a distance, as in {text}/5")
    for name in ("NEAR/", "ONEAR/"):
        if text.startswith(name):
            number = text[len(name) :]
            digits = number.removeprefix("+").lstrip("0")
            if not re.fullmatch(r"\+?[0-9]+", number, re.ASCII) or len(digits) > len(str(MAX_DISTANCE)) or int(digits or 0) > MAX_DISTANCE:
                raise fail(span, f"{number or 'nothing'} is not a distance")
            if not digits:
                raise fail(span, "a distance is 1 or more")
            return Lexeme("near", span, distance=int(digits), ordered=name == "ONEAR/")
    stem = text.removesuffix("*")
    if "*" in stem:
        at = span.start + len(stem[: stem.index("*")].encode())
        raise fail(Span(at, at + 1), "a * can only end a word")
    terms = tuple(t.normalized for t in tokenize(stem))
    starred = stem != text
    if not terms:
        raise fail(span, "this word has no characters to search for")
    if starred and len(terms) > 1:
        raise fail(span, "a * needs a single term before it")
    return Lexeme("prefix" if starred else "term" if len(terms) == 1 else "phrase", span, terms)


class Level:
    """What is read so far inside one pair of parentheses (or of the whole query): an operand of NEAR, of AND and NOT, of OR."""

    def __init__(self, opened: Lexeme | None):
        self.opened = opened
        self.near: tuple[Expr, Span] | None = None
        self.both: tuple[Expr, Span] | None = None
        self.either: tuple[Expr, Span] | None = None
        self.beside: Lexeme | None = None
        self.kind: type[Pair] = And

    def operand(self, expr: Expr, span: Span) -> None:
        if self.beside:
            positional(expr, span)
            left, begin = self.near
            expr, span = Near(left, expr, self.beside.distance, self.beside.ordered), begin.to(span)
            self.beside = None
        self.near = expr, span

    def operator(self, kind: type[Pair], item: Lexeme | None) -> None:
        if kind is Near:
            positional(*self.near)
            self.beside = item
            return
        self.both = joined(self.kind, self.both, self.near)
        if kind is Or:
            self.either, self.both = joined(Or, self.either, self.both), None
        else:
            self.kind = kind

    def close(self) -> tuple[Expr, Span]:
        return joined(Or, self.either, joined(self.kind, self.both, self.near))


def joined(kind: type[Pair], left: tuple[Expr, Span] | None, right: tuple[Expr, Span]) -> tuple[Expr, Span]:
    return (kind(left[0], right[0]), left[1].to(right[1])) if left else right


class Parser:
    """One loop over the lexemes with a stack of open groups, so that groups nest to any depth."""

    def __init__(self, query: str):
        self.items, self.at, self.end = lex(query), 0, len(query.encode("utf-8", "surrogatepass"))

    def peek(self) -> Lexeme | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def take(self, *kinds: str) -> Lexeme | None:
        item = self.peek()
        if item and item.kind in kinds:
            self.at += 1
            return item
        return None

    def whole(self) -> Expr:
        if not self.items:
            raise QueryError(0, 0, "the query is empty")
        levels = [Level(None)]
        while True:
            while opened := self.take("("):
                if (n := self.peek()) and n.kind == ")":
                    raise fail(opened.span.to(n.span), "this group is empty")
                levels.append(Level(opened))
            expr, span = self.primary()
            while True:
                level = levels[-1]
                level.operand(expr, span)
                if self.operator(level):
                    break
                expr, span = level.close()
                if not level.opened:
                    if rest := self.peek():
                        raise fail(rest.span, "this ) closes nothing")
                    return expr
                close = self.take(")")
                if not close:
                    raise fail(level.opened.span, "this group is never closed")
                span = level.opened.span.to(close.span)
                levels.pop()

    def operator(self, level: Level) -> bool:
        """Takes an operator, or sees that an operand stands right beside; otherwise the level ends here."""
        item = self.take("near", "and", "or", "not")
        if not item and not ((n := self.peek()) and n.kind in ("term", "prefix", "phrase", "(")):
            return False
        level.operator({"near": Near, "or": Or, "not": Not}.get(item.kind, And) if item else And, item)
        return True

    def primary(self) -> tuple[Expr, Span]:
        item = self.peek()
        if not item:
            before = self.items[-1]
            raise QueryError(self.end, 0, f"something to search for is missing after {before}")
        self.at += 1
        if item.kind == "term":
            return Term(item.terms[0]), item.span
        if item.kind == "prefix":
            return Prefix(item.terms[0]), item.span
        if item.kind == "phrase":
            return Phrase(item.terms), item.span
        raise fail(item.span, "this ) stands where a term belongs" if item.kind == ")" else f"the operator {item} stands where a term belongs")


def positional(expr: Expr, span: Span) -> None:
    if not expr.is_positional():
        raise fail(span, "NEAR needs terms, phrases, or alternatives of them: this has no positions")


def parse(query: str) -> Expr:
    return Parser(query).whole()


def point_at(query: str, error: QueryError) -> str:
    """The query and below it a line of carets under the characters in question."""
    raw = query.encode("utf-8", "surrogatepass")
    before = len(raw[: error.offset].decode("utf-8", "replace"))
    under = len(raw[error.offset : error.offset + error.length].decode("utf-8", "replace"))
    return f"{query}\n{' ' * before}{'^' * max(1, under)}"
