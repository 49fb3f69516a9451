"""Dependent rules and rule files."""

import itertools
import random

import pytest
from gristmill.operators import layers
from gristmill.sources import rulefile

D = layers.Dependent


def test_layers_and_cycles():
    rules = [D("C", "A & B"), D("B", "A | x"), D("A", "x & !y"), D("Z", "q")]
    assert [[r.symbol for r in layer] for layer in layers.layered(rules)] == [["A", "Z"], ["B"], ["C"]]
    with pytest.raises(layers.CycleError, match="A -> B -> C -> A|B -> C -> A -> B|C -> A -> B -> C"):
        layers.layered([D("A", "B"), D("B", "C & x"), D("C", "!A"), D("Z", "A")])
    with pytest.raises(layers.CycleError, match="A -> A"):
        layers.layered([D("A", "A | x")])
    with pytest.raises(ValueError, match="two rules"):
        layers.layered([D("A", "x"), D("A", "y")])
    deep = [D(f"R{k}", f"R{k + 1}" if k < 4999 else "x") for k in range(5000)]
    assert len(layers.layered(deep)) == 5000 and layers.layered([]) == []


def python(expression, has):
    text = expression.replace("&", " and ").replace("|", " or ").replace("!", " not ")
    return bool(eval(text, {}, {s: s in has for s in "abcdefgh"} | {s: s in has for s in ("R0", "R1", "R2")}))


def test_against_python(spark, monkeypatch):
    rng = random.Random(9)

    def made(depth, atoms):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(atoms)
        op = rng.choice(["&", "|", "!"])
        return f"!({made(depth - 1, atoms)})" if op == "!" else f"({made(depth - 1, atoms)}) {op} ({made(depth - 1, atoms)})"

    rules = [D("R0", made(3, "abcd")), D("R1", made(3, [*"abcd", "R0"])), D("R2", made(4, [*"efgh", "R0", "R1"])), D("R3", "a + b + R0 > 1"), D("R4", made(3, "abcdefgh"))]
    sets = [(i, {s for s in "abcdefgh" if rng.random() < 0.4}) for i in range(80)] + [(80, set()), (None, {"a"})]
    ids = spark.createDataFrame([(i, "clash") for i, _ in sets], "id long, symbols string")
    found = spark.createDataFrame([(i, s) for i, own in sets for s in [*own, *own]] + [(3, None)], "id long, symbol string")
    want = set()
    for i, own in sets:
        has = set(own)
        for r in rules:
            if (sum(s in has for s in ("a", "b", "R0")) > 1) if r.symbol == "R3" else python(r.expression, has):
                has.add(r.symbol)
                want.add((i, r.symbol))
    for most in (layers.CLAUSES, 1):
        monkeypatch.setattr(layers, "CLAUSES", most)
        got = layers.evaluate(ids, found, rules).collect()
        assert len(got) == len(want) and {(r.id, r.symbol) for r in got} == want


def test_thousands_of_rules(spark):
    """A row meets the clauses of its own symbols only; the plan does not grow with the rules."""
    rules = [D(f"P{i}_{j}", f"s{i} & s{j}") for i, j in itertools.combinations(range(80), 2)]
    rows = [(k, f"s{x}") for k in range(20) for x in {k, k + 7, 3 * k % 80, 79 - k}]
    got = layers.evaluate(spark.createDataFrame([(k,) for k in range(20)], "id long"), spark.createDataFrame(rows, "id long, symbol string"), rules)
    own = {k: sorted({int(s[1:]) for i, s in rows if i == k}) for k in range(20)}
    assert {(r.id, r.symbol) for r in got.collect()} == {(k, f"P{a}_{b}") for k, xs in own.items() for a, b in itertools.combinations(xs, 2)}


def test_gates(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    found = spark.createDataFrame([(1, "m", "x"), (1, "a", "y"), (2, "m", "x"), (3, "n", "z"), (3, None, "z")], "id long, symbol string, note string")
    got = {tuple(r) for r in layers.gated(ids, found, {"m": "a & !b", "n": "!a"}).collect()}
    assert got == {(1, "m", "x"), (1, "a", "y"), (3, "n", "z"), (3, None, "z")}


def test_patterns_of_files():
    assert rulefile.java_pattern(r"/a\/b/i") == "(?i)a/b" and rulefile.java_pattern("m{x/y}") == "x/y" and rulefile.java_pattern("m!a!si") == "(?is)a" and rulefile.java_pattern("a") is None
    assert rulefile.java_pattern("m|a|") == "a"


def test_files(spark):
    rules = rulefile.load(r"""
ifplugin Some::Plugin
header A  Subject =~ /^hello/i   # not a comment here
endif
header B  To:addr =~ /^bob@/
header N  To:name =~ /^Bob$/
header F  From !~ /x/
header G  X-None !~ /x/
header E  eval:check_something()
header U  X-None =~ /^free$/ [if-unset: free]
mimeheader M Content-Type =~ m{text/html}
body   C  /two words/
body   __S /^Hello/
uri    L  /\.zip$/
meta   T  A && (C || L) && !NOWHERE
meta   V  (A + B + C) >= 3
meta   W  T && V
score  A  0 1 2 3.5
score  T  -2
describe T  text # note
tflags V  nice
nonsense line
header A  Subject =~ /hello/i
""".replace("   # not a comment here", "").splitlines())
    assert rules.skipped == ["header E  eval:check_something()", "nonsense line"] and rules.texts == {"T": "text"}
    raw = "Subject: Hello\n  there\nTo: \"Bob\" <bob@x>\nFrom: a\nContent-Type: text/html\n"
    rows = [(1, raw, "these two\n  words http://a/b.zip "), (2, None, None), (3, "Subject: say hello\nFrom: x", "nothing")]
    got = {(r.id, r.symbol): r.score for r in rulefile.findings(spark.createDataFrame(rows, "id long, raw string, body string"), rules).collect()}
    assert got == {(1, "A"): 3.5, (1, "B"): 1.0, (1, "N"): 1.0, (1, "F"): 1.0, (1, "G"): 1.0, (1, "U"): 1.0, (1, "M"): 1.0, (1, "C"): 1.0, (1, "L"): 1.0, (1, "T"): -2.0, (1, "V"): -1.0, (1, "W"): 1.0, (2, "F"): 1.0, (2, "G"): 1.0, (2, "U"): 1.0, (3, "A"): 3.5, (3, "G"): 1.0, (3, "U"): 1.0}
    with pytest.raises(layers.CycleError):
        rulefile.findings(spark.createDataFrame(rows, "id long, raw string, body string"), rulefile.load(["meta P Q", "meta Q P"]))
    assert rulefile.findings(spark.createDataFrame(rows, "id long, raw string, body string"), rulefile.load([])).count() == 0
