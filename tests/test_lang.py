import pytest

from curvelake.errors import FieldError
from curvelake.functions import formula
from curvelake.plans import lang
from curvelake.sources.template import Template

CASES = [
    "a.E - b.E", "-x^2", "2^-3^2", "a * b / c", "a - (b - c)", "(a + b) * c", "d(C, T, order=2)", "y @ T=0.5", "at(y, T=[0.1, 1])", "ed.E[T=0.05:, L=14]",
    "a[U!=[1, 2], s='x', T>=r.lo, T=:3]", "max(a, b) + argmax(C) / gap.gap", "(a + b)^2", "using(y, method=linear)",
]


@pytest.mark.parametrize("text", CASES)
def test_round_trip(text):
    tree = lang.parse(text)
    assert lang.parse(lang.show(tree)) == tree


def test_precedence():
    assert formula.constant(lang.parse("2+3*4^2")) == 50
    assert formula.constant(lang.parse("-2^2")) == -4
    assert formula.constant(lang.parse("2**3**2")) == 512
    assert formula.constant(lang.parse("8/4/2")) == 1


@pytest.mark.parametrize("bad", ["a +", "a b", "(a", "a.[1]", "f(,)", "a[T]"])
def test_errors(bad):
    with pytest.raises(FieldError):
        lang.parse(bad)


def test_tests_on_values():
    t = lang.parse_tests("U=2.0, T=0.1:0.5, n!=[1,2]")
    assert formula.test_value(t[0], 2.00000000000001) and not formula.test_value(t[0], 2.1)
    assert formula.test_value(t[1], 0.5) and not formula.test_value(t[1], 0.51)
    assert formula.test_value(t[2], 3) and not formula.test_value(t[2], 2)


def test_template():
    t = Template("data/U_{U}/n_{n:int}_{s:str}*.dat")
    assert t.match("data/U_-1.5e-3/n_4_abc_x.dat") == {"U": -0.0015, "n": 4, "s": "a"} or t.match("data/U_-1.5e-3/n_4_abc_x.dat")["U"] == -0.0015
    assert t.match("data/U_1/x/n_4_abc.dat") is None
    assert t.match(".hidden/U_1/n_4_a.dat") is None
    assert t.fixed == "data"
    with pytest.raises(FieldError):
        Template("{a}/{a}")
