import pytest
from gristmill.functions import expr
from pyspark.sql import functions as F

#: Expressions and their postfix forms, then expressions and their values.
POSTFIX = {
    "A & (!B | C)": "(A) (B) ! (C) | &",
    "A & B | !C": "(C) ! (A) (B) & |",
    "A & (B | !C)": "(A) (B) (C) ! | &",
    "(((A)))": "(A)",
    "A + B + C + D > 2": "(A) (B) (C) (D) +(4) 2 >",
    "((A + B + C + D) > 2) & D": "(D) (A) (B) (C) (D) +(4) 2 > &",
    "A | B | C & D & E": "(A) (B) (C) (D) (E) &(3) |(3)",
    "1 | 0 & 0 | 0": "(1) (0) (0) (0) & |(3)",
    "A + B + -C": "(A) (B) (-C) +(3)",
    "(A) & (B) & ((C) | (D) | (E) | (F))": "(A) (B) (C) (D) (E) (F) |(4) &(3)",
}
VALUES = {
    "(E) && ((B + B + B + B) >= 1)": 0, "A & B | !C": 0, "A & (!B | C)": 1, "A + B + C + D + E + F >= 2": 1,
    "((A + B + C + D) > 1) & F": 0, "(A + B + C + D) > 1 && F || E": 1, "(A + B + C + D) > 100 && F || !E": 0, "!!C": 1,
    "A & C & (!D || !C || !E)": 1, "A & C & !(D || C || E)": 0, "A + B + C": 2, "A * 2.0 + B + C": 3,
    "A * 2.0 + B - C": 1, "A / 2.0 + B - C": -0.5, "A + B + -C": 0,
}


@pytest.mark.parametrize("text", POSTFIX)
def test_postfix(text):
    assert expr.parse(text).postfix() == POSTFIX[text]


@pytest.mark.parametrize("text", ["A & B &", "(((A))", "", "A B", "| A"])
def test_malformed(text):
    with pytest.raises(expr.ExpressionError):
        expr.parse(text)


def test_values(spark):
    atoms = {a: F.lit(1 if a in "ACE" else 0) for a in "ABCDEF"}
    row = spark.range(1).select(*[expr.evaluate(t, atoms).alias(str(i)) for i, t in enumerate(VALUES)]).first()
    assert list(row) == [float(v) for v in VALUES.values()]
