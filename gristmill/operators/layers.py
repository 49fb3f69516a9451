"""Rules over symbols that may use the symbols of other rules: layers, cycles, and an inverted index.

A rule of ``&``, ``|`` and ``!`` is taken apart into clauses: symbols that must
be there and symbols that must not. Each clause is filed under one symbol that
it needs, so a row meets only clauses of symbols that it has, however many rules
there are. Rules that count or compare are compiled into one Column each.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import expr
from gristmill.operators.maps import small

#: Clauses beyond which a rule is compiled instead of taken apart.
CLAUSES = 500
#: Files clauses that need no symbol; every row has it.
ALWAYS = ""


class CycleError(ValueError):
    """Rules that need each other's result."""


@dataclass(frozen=True)
class Dependent:
    """A symbol and the expression over other symbols that yields it."""

    symbol: str
    expression: str


def layered(rules: list[Dependent]) -> list[list[Dependent]]:
    """The rules in layers: each rule needs only symbols of layers before its own; raises CycleError with the way round."""
    if len({r.symbol for r in rules}) < len(rules):
        raise ValueError("a symbol has two rules")
    by_symbol = {r.symbol: r for r in rules}
    needs = {r.symbol: sorted(set(expr.parse(r.expression).atoms()) & set(by_symbol)) for r in rules}
    depth: dict[str, int] = {}
    for first in by_symbol:
        path, place = [first], {first: 0}
        todo = [iter(needs[first])] if first not in depth else []
        while todo:
            child = next((c for c in todo[-1] if c not in depth), None)
            if child is None:
                done = path.pop()
                place.pop(done)
                todo.pop()
                depth[done] = 1 + max((depth[n] for n in needs[done]), default=-1)
            elif child in place:
                raise CycleError(" -> ".join([*path[place[child] :], child]))
            else:
                place[child] = len(path)
                path.append(child)
                todo.append(iter(needs[child]))
    return [[r for r in rules if depth[r.symbol] == k] for k in range(max(depth.values(), default=-1) + 1)]


def clauses(node: expr.Node, negated: bool = False) -> list[tuple[frozenset[str], frozenset[str]]] | None:
    """(needed, excluded) symbols of each way to meet the expression; None if it is not of ``& | !`` alone or has too many."""
    if node.op is None:
        if node.text.replace(".", "", 1).isdigit():
            return None
        return [(frozenset(), frozenset({node.text}))] if negated else [(frozenset({node.text}), frozenset())]
    if node.op == "!":
        return clauses(node.items[0], not negated)
    if node.op not in ("&", "|"):
        return None
    parts = [clauses(i, negated) for i in node.items]
    if any(p is None for p in parts):
        return None
    if (node.op == "|") != negated:
        out = [c for p in parts for c in p]
    else:
        size = 1
        for p in parts:
            size *= max(1, len(p))
        if size > CLAUSES:
            return None
        out = [(frozenset().union(*(c[0] for c in way)), frozenset().union(*(c[1] for c in way))) for way in product(*parts)]
    out = list(dict.fromkeys(c for c in out if not c[0] & c[1]))
    return out if len(out) <= CLAUSES else None


def _compiled(rule: Dependent) -> Column:
    return F.when(expr.compile_expression(expr.parse(rule.expression), lambda a: F.array_contains("symbols", a).cast("int")) != 0, F.lit(rule.symbol))


def _layer(state: DataFrame, rules: list[Dependent]) -> DataFrame:
    """``state`` (id, symbols) with the symbols of one layer added."""
    rows, compiled = [], []
    for r in rules:
        found = clauses(expr.parse(r.expression))
        if found is None:
            compiled.append(r)
        else:
            rows += [(min(need, default=ALWAYS), r.symbol, sorted(need), sorted(never)) for need, never in found]
    added = [F.array_compact(F.array(*map(_compiled, compiled)))] if compiled else []
    if rows:
        index = state.sparkSession.createDataFrame(rows, "key string, rule string, need array<string>, never array<string>")
        each = state.select("id", "symbols", F.explode(F.concat(F.array(F.lit(ALWAYS)), "symbols")).alias("key")).join(small(index), "key", "left")
        met = (F.size(F.array_except("need", "symbols")) == 0) & ~F.arrays_overlap("never", "symbols")
        state = each.groupBy("id").agg(F.first("symbols").alias("symbols"), F.collect_set(F.when(met, F.col("rule"))).alias("met"))
        added.append(F.col("met"))
    return state.select("id", F.array_union("symbols", F.concat(*added)).alias("symbols")) if added else state


def evaluate(ids: DataFrame, findings: DataFrame, rules: list[Dependent], id_col: str = "id") -> DataFrame:
    """(id_col, symbol, layer): the rules that are met, for every id of ``ids``.

    ``findings`` has id_col and symbol. After one shuffle by id all layers run in
    place: each meets its index by a broadcast join once counting shows that it
    is small. A finding that is named like a rule counts as that rule's result
    for others and is not reported again. Null symbols do not count; repeated
    findings count once; ids without findings can meet rules of what is absent;
    null ids are one id.
    """
    layers = layered(rules)
    has = findings.filter("symbol is not null").select(F.col(id_col).alias("id"), "symbol")
    every = ids.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("symbol")).distinct()
    state = every.unionByName(has).groupBy("id").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))
    start = state.withColumn("own", F.col("symbols"))
    for layer in layers:
        carried = start.select(F.struct("id", "own").alias("id"), "symbols")
        start = _layer(carried, layer).select("id.id", "id.own", "symbols")
    level = F.create_map(*[F.lit(x) for k, layer in enumerate(layers) for r in layer for x in (r.symbol, k + 1)]) if rules else F.create_map().cast("map<string,int>")
    return start.select(F.col("id").alias(id_col), F.explode(F.array_except("symbols", "own")).alias("symbol")).withColumn("layer", level[F.col("symbol")])


def gated(ids: DataFrame, findings: DataFrame, gates: dict[str, str], id_col: str = "id") -> DataFrame:
    """``findings`` without those whose gate, an expression over the other findings of the id, is not met."""
    if not gates:
        return findings
    held = evaluate(ids, findings, [Dependent(f"gate {s}", e) for s, e in gates.items()], id_col).select(F.col(id_col).alias("__id"), F.expr("substr(symbol, 6)").alias("__symbol"))
    gate = F.col("symbol").isin(list(gates))
    open_ = findings.filter(gate).join(held, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("symbol") == F.col("__symbol")), "left_semi")
    return findings.filter(~gate | F.col("symbol").isNull()).unionByName(open_)
