import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.errors import QueryError
from tessera.functions.text import format_bytes, format_count, format_duration, rate, tokenize, truncate_text
from tessera.plans.query import And, Near, Not, Or, Phrase, Prefix, Term, lex, parse, point_at


def terms(text):
    return [t.normalized for t in tokenize(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("--- ,,,", []),
        ("isn't sailors' bits 'o' string", ["isn't", "sailors", "bits", "o", "string"]),
        ("2.75 12,500 i.e. 9.30.1", ["2.75", "12,500", "i", "e", "9.30.1"]),
        ("up-to-date", ["up", "to", "date"]),
        ("Rye茶道z", ["rye", "茶", "道", "z"]),
        ("a_b\nc", ["a", "b", "c"]),
        ("İ ẞ naïve \U0001f130", ["i̇", "ß", "naïve", "\U0001f130"]),
    ],
)
def test_tokens(text, expected):
    assert terms(text) == expected


@given(st.text(alphabet=st.sampled_from("a1'’.,-_ é量\n\t "), max_size=40))
def test_token_invariants(text):
    tokens = list(tokenize(text))
    raw = text.encode()
    assert [t.position for t in tokens] == list(range(len(tokens)))
    for t in tokens:
        assert raw[t.offset : t.end].decode() == t.text
        assert not any(c.isspace() for c in t.text)
    assert all(a.end <= b.offset for a, b in zip(tokens, tokens[1:]))


def test_long_tokens():
    for text in ("a" * 200_000, "a'" * 100_000 + "a", "1," * 100_000 + "1"):
        assert len(list(tokenize(text))) == 1


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("a b OR c NOT d", Or(And(Term("a"), Term("b")), Not(Term("c"), Term("d")))),
        ("and Or", And(Term("and"), Term("or"))),
        ("AND*", Prefix("and")),
        ('"class*"', Term("class")),
        ("'a b'", Phrase(("a", "b"))),
        ("foo:bar", Phrase(("foo", "bar"))),
        ("a NEAR/+3 b ONEAR/2 c", Near(Near(Term("a"), Term("b"), 3, False), Term("c"), 2, True)),
        ("a NOT b AND c", And(Not(Term("a"), Term("b")), Term("c"))),
        ("((a))(b)", And(Term("a"), Term("b"))),
        ("a NEAR/" + "0" * 5000 + "7 b", Near(Term("a"), Term("b"), 7)),
    ],
)
def test_parse(query, expected):
    assert parse(query) == expected
    assert parse(str(expected)) == expected


@pytest.mark.parametrize(
    ("query", "offset", "length"),
    [
        ("", 0, 0), ("   ", 0, 0), ("()", 0, 2), ("(a", 0, 1), ("a )", 2, 1), ("a AND", 5, 0), ('é "abc', 3, 4), ('""', 0, 2), ("NEAR", 0, 4), ("a NEAR/0 b", 2, 6),
        ("a NEAR/-3 b", 2, 7), ("a NEAR/3x b", 2, 7), ("a NEAR/4294967296 b", 2, 15), ("a NEAR/" + "9" * 5000 + " b", 2, 5005), ("a NEAR/" + "0" * 5000 + " b", 2, 5005), ("a OR", 4, 0), ("a**", 1, 1), ("é*f", 2, 1), ("*", 0, 1), ("foo-bar*", 0, 8), ("OR a", 0, 2), ("(a AND b) NEAR/2 c", 0, 9), ("a NEAR/2 (b NOT c)", 9, 9),
    ],
)
def test_errors_point_at_bytes(query, offset, length):
    with pytest.raises(QueryError) as e:
        parse(query)
    assert (e.value.offset, e.value.length) == (offset, length)
    assert str(e.value).startswith(f"invalid query at byte {offset}: ")


def test_a_missing_operand_names_the_operator():
    with pytest.raises(QueryError, match="missing after NEAR/3"):
        parse("a NEAR/3 ")


def test_caret_counts_characters():
    with pytest.raises(QueryError) as e:
        parse('é "abc')
    assert point_at('é "abc', e.value) == 'é "abc\n  ^^^^'


def test_spans_are_ordered():
    spans = [x.span for x in lex('é (a OR "b c") NEAR/2 d*')]
    assert all(a.end <= b.start for a, b in zip(spans, spans[1:]))


def test_positional():
    assert parse("(a OR b) NEAR/2 'c d'").is_positional()
    assert not parse("a AND b").is_positional()
    assert parse("a NEAR/1 b OR c").size() == 5


def test_presentation():
    assert [format_bytes(x) for x in (5, 2048, 3 << 20)] == ["5 B", "2.0 KiB", "3.0 MiB"]
    assert format_count(1234567.4) == "1,234,567"
    assert [format_duration(x) for x in (1.234, 0.0123, 0.00123, 0.0000123, 5e-9)] == ["1.23 s", "12 ms", "1.23 ms", "12 µs", "5 ns"]
    assert rate(5, 0) == 0
    assert truncate_text("abcdef", 4) == "abc…"
