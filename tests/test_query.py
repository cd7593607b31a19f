import pytest
from hypothesis import given
from hypothesis import strategies as st

from slabworks.plans.query import QueryError, Span, Term, parse_query, parse_slab


@pytest.mark.parametrize(
    ("text", "terms"),
    [
        ("wind", [Term("wind")]),
        ("wind[3:8]", [Term("wind", None, (Span(3, 8),))]),
        ("wind.lat[3:8]", [Term("wind", "lat", (Span(3, 8),))]),
        ("lat[2:6],wind.lat[7][1],wind", [Term("lat", None, (Span(2, 6),)), Term("wind", "lat", (Span(7, 7), Span(1, 1))), Term("wind")]),
        ("wind%5B3:8%5D", [Term("wind", None, (Span(3, 8),))]),
        ("a+b", [Term("a+b")]),
        ("", [Term("")]),
        ("t[4]]", [Term("t", None, (Span(4, 4),))]),
        ("t[4]][1:2]", [Term("t", None, (Span(4, 4), Span(1, 2)))]),
        ("t[+3]", [Term("t", None, (Span(3, 3),))]),
        ("a.b.c", [Term("a", "b.c")]),
    ],
)
def test_terms(text, terms):
    assert parse_query(text) == tuple(terms)


@pytest.mark.parametrize("text", ["w[x]", "w[7", "w.w[2:4:6:8]", "w[]", "w[-2]", "w[ 2]", "w[2]3]", "w[2:]", "w[[2]", "w[2]x[3]", "%ff"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse_query(text)


@given(st.lists(st.lists(st.integers(0, 10**12), min_size=1, max_size=3), min_size=1, max_size=6), st.data())
def test_any_slab_comes_back(numbers, data):
    text = "".join(f"[{':'.join(map(str, n))}]" + "]" * data.draw(st.integers(0, 2)) for n in numbers)
    assert parse_slab(text) == tuple(Span(n[0], n[-1], n[1] if len(n) == 3 else None) for n in numbers)


def test_counts_and_what_is_no_slab():
    assert [s.count for s in parse_slab("[9][4:9][4:2:9][4:3:10]")] == [1, 6, 3, 3]
    for bad in ("[1:2:3:4]", "[5:b:6]", "[]", "2:3", "", "]", "[1]x"):
        with pytest.raises(QueryError):
            parse_slab(bad)
