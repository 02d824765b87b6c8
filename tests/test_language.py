import math

import pytest

from mathframe.lang.expression import Step, parse_expression
from mathframe.lang.predicate import Every, Some, Unless, parse_where
from mathframe.lang.predicate import Test as Check


def written(text):
    """An expression's programs as words, in the order in which a stack takes them."""
    formula = parse_expression(text)
    words = {"push": "{0.of}", "load": "{0.of}", "word": "'{0.of}'", "negate": "neg", "apply": "{0.of}", "call": "{0.of}/{0.count}"}
    sides = [" ".join(words[s.what].format(s) + "".join(f":{k}" for k in s.keywords) for s in side) for side in formula.sides]
    return f" {formula.relation} ".join(sides) if formula.relation else sides[0]


@pytest.mark.parametrize(
    "text, program",
    [
        ("7", "7"), ("2.25", "2.25"), ("8.", "8.0"), ("2.5e2", "250.0"), ("inf", "inf"), (".inf", "inf"), ("infeed", "infeed"), ("_q2", "_q2"),
        ("u + v", "u v +"), ("u + v * w", "u v w * +"), ("(u + v) * w", "u v + w *"), ("u - v - w", "u v - w -"), ("u / v * w", "u v / w *"),
        ("u ** v ** w", "u v w ** **"), ("-u ** v", "u neg v **"), ("u ** -v", "u v neg **"), ("- - u", "u"), ("+u", "u"),
        ("u >= v", "u >= v"), ("u - v == 2 * w", "u v - == 2 w *"), ("g()", "g/0"), ("sum(u, over=t)", "u 't' sum/2:over"), ("g(k=3, u)", "u 3 g/2:k"),
        ("roll(u, t=-2)", "u 2 neg roll/2:t"), ("g(h(u) + 1, w=2 * v)", "u h/1 1 + 2 v * g/2:w"),
    ],
)
def test_expression(text, program):
    assert written(text) == program


def test_numbers_keep_their_kind():
    assert parse_expression("7").sides == ((Step("push", 7),),) and isinstance(parse_expression("7").sides[0][0].of, int)
    assert parse_expression("-inf").sides[0] == (Step("push", math.inf), Step("negate"))


@pytest.mark.parametrize("text", ["u +", "", "u v", "1e5", ".5", "u < v", "u != v", "u == v == w", "(u", "g(u", "u = v", "(u <= v)", "g(u, )", "u $ v", "g(k=1, k=2)"])
def test_bad_expression(text):
    with pytest.raises(ValueError, match="Failed to parse"):
        parse_expression(text)


U, V, W = Check("u"), Check("v"), Check("w")


@pytest.mark.parametrize(
    "text, tree",
    [
        ("True", Every()), ("FALSE", Some()), ("u", U), ("u >= 3", Check("u", ">=", 3)), ("u != -2.5", Check("u", "!=", -2.5)), ("u == solar", Check("u", "==", "solar")),
        ("u AND v", Every((U, V))), ("u and v and w", Every((U, V, W))), ("u or v and w", Some((U, Every((V, W))))), ("(u OR v) AND w", Every((Some((U, V)), W))),
        ("NOT u AND v", Every((Unless(U), V))), ("not not u", Unless(Unless(U))), ("NOT (u OR v)", Unless(Some((U, V)))), ("NoT u Or tRue", Some((Unless(U), Every()))),
    ],
)
def test_where(text, tree):
    assert parse_where(text) == tree


@pytest.mark.parametrize("text", ["", "NOT", "u AND", "AND", "u >", "u v", "1 > u", "(u", "u > inf > v"])
def test_bad_where(text):
    with pytest.raises(ValueError, match="Failed to parse"):
        parse_where(text)
