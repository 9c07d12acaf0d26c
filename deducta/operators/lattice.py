"""Recursive min and max: a relation keeps the best value of each group, and better ones replace it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analysis import components, dependencies, validate
from ..plans.ast import DatalogError, Program, Rule, Struct, aggregate_of
from ..plans.compiler import Relations, body, columns_of, name
from .fixpoint import Fixpoint, cut, union


def lattices(clauses: list[Rule]) -> dict[str, tuple[int, str]]:
    """Predicates that recur through min or max: their value's place and function.

    A value read in the recursion may only flow into the head's aggregate or be compared so that a
    better one keeps the comparison true, unless a partner rule covers the other case.
    """
    rules = [c for c in clauses if c.body and c.head]
    home = {p: k for k, g in enumerate(components(dependencies(rules))) for p in g}
    found: dict[str, tuple[int, str]] = {}
    for r in rules:
        a = aggregate_of(r.head)
        if a and a[1] in ("min", "max") and any(home.get(x.atom.pred) == home[r.head.pred] for x in r.positive):
            found[r.head.pred] = a[:2]
    for r in rules:
        for x in r.negative:
            if x.atom.pred in found:
                raise DatalogError(f"{x} reads a relation that keeps only its best rows: {r}")
        if r.head.pred not in found:
            continue
        a = aggregate_of(r.head)
        if not a or a[:2] != found[r.head.pred]:
            raise DatalogError(f"every rule of {r.head.pred} must take {found[r.head.pred][1]} at the same place: {r}")
        for x in r.positive:
            if home.get(x.atom.pred) == home[r.head.pred]:
                other = found.get(x.atom.pred)
                if other is None or other[1] != a[1]:
                    raise DatalogError(f"recursion through {a[1]} must stay among predicates that take {a[1]}: {r}")
                value = x.atom.args[other[0]]
                if sum(value in y.atom.variables for y in r.positive) > 1 or any(value == t for k, t in enumerate(r.head.args) if k != a[0]):
                    raise DatalogError(f"{value} may be used only in the aggregate or a comparison: {r}")
                for t in r.comparisons:
                    if value in t.atom.variables and not _monotone(t.atom, value, a[1]) and not _partnered(r, t, rules):
                        raise DatalogError(f"a better {value} could make {t} false: {r}")
    return found


def _monotone(atom, value, function: str) -> bool:
    falling = {"<": 0, "<=": 0, ">": 1, ">=": 1}
    if atom.pred not in falling:
        return False
    side = atom.args.index(value)
    return (side == falling[atom.pred]) == (function == "min")


_OPPOSITE = {"<": ">=", ">=": "<", ">": "<=", "<=": ">", "=": "!=", "!=": "="}


def _partnered(rule: Rule, test, rules: list[Rule]) -> bool:
    """Whether another rule of the head has the same body but for the opposite comparison."""
    flip = {">": "<", "<": ">", ">=": "<=", "<=": ">=", "=": "=", "!=": "!="}
    opposite = _OPPOSITE[test.atom.pred]
    forms = {(opposite, test.atom.args), (flip[opposite], test.atom.args[::-1])}
    rest = [x for x in rule.body if x != test]
    return any(o is not rule and o.head.pred == rule.head.pred and [x for x in o.body if not x.atom.comparison] == [x for x in rest if not x.atom.comparison] and any((t.atom.pred, t.atom.args) in forms for t in o.comparisons) for o in rules)


def best(spark: SparkSession, clauses: list[Rule], external: Relations | None = None, max_rounds: int = 1000) -> Relations:
    """All relations, lattice predicates with their best rows; what does not recur so is evaluated as ever."""
    external = external or {}
    found = lattices(clauses)
    arity = validate(clauses, {p: len(d.columns) for p, d in external.items()})
    rules = [c for c in clauses if c.body and c.head]
    relations: Relations = {p: d.toDF(*columns_of(arity[p])).distinct() for p, d in external.items()}
    facts = [c for c in clauses if c.head and not c.body]
    plans = set(external)
    for group in components(dependencies(rules)):
        own = [r for r in rules if r.head.pred in group]
        if not own and not any(f.head.pred in group for f in facts):
            continue
        if not any(p in found for p in group):
            part = Program([f for f in facts if f.head.pred in group], own, [], {p: n for p, n in arity.items() if p in relations or p in group}, [group])
            relations |= {p: d for p, d in Fixpoint(spark, part, relations).run().items() if p in group}
            continue
        if any(f.head.pred in group for f in facts):
            raise DatalogError(f"state facts of {group[0]} through a rule")
        for p in sorted(plans & {x.atom.pred for r in own for x in r.body}):
            relations[p] = cut(relations[p])  # every round reads it
            plans.discard(p)
        relations |= _improve(group, own, found, relations, max_rounds)
    return relations


def _fold(p: str, rows: DataFrame, found: dict[str, tuple[int, str]]) -> DataFrame:
    place, function = found[p]
    value = f"c{place}"
    keys = [c for c in rows.columns if c != value]
    f = F.min(value) if function == "min" else F.max(value)
    return rows.groupBy(*keys).agg(f.alias(value)).select(*rows.columns)


def _rows(rule: Rule, relations: Relations, delta: dict[int, DataFrame] | None = None) -> DataFrame:
    place, _, v = aggregate_of(rule.head)
    plain = tuple(v if k == place else a for k, a in enumerate(rule.head.args))
    frame = body(rule, relations, delta, keep_all=True)
    return frame.select(*((F.lit(a.value) if not hasattr(a, "name") else F.col(name(a))).alias(c) for a, c in zip(plain, columns_of(len(plain)), strict=True) if not isinstance(a, Struct)))


def _improve(group: list[str], rules: list[Rule], found: dict[str, tuple[int, str]], relations: Relations, max_rounds: int) -> Relations:
    start = [r for r in rules if not any(x.atom.pred in group for x in r.positive)]
    loop = [r for r in rules if r not in start]
    now: Relations = {}
    for p in group:
        parts = [_rows(r, relations) for r in start if r.head.pred == p]
        if not parts:
            raise DatalogError(f"{p} has no rule to start from")
        now[p] = cut(_fold(p, union(parts), found))
    delta = dict(now)
    for _ in range(max_rounds):
        new: Relations = {}
        for p in group:
            parts = [_rows(r, {**relations, **now}, {k: delta[x.atom.pred]}) for r in loop if r.head.pred == p for k, x in enumerate(r.body) if not x.negated and x.atom.pred in delta]
            if not parts:
                continue
            better = _fold(p, union([now[p], *parts]), found).join(now[p], now[p].columns, "left_anti")
            better = cut(better)
            if not better.isEmpty():
                new[p] = better
        if not new:
            return now
        for p, rows in new.items():
            now[p] = cut(_fold(p, now[p].union(rows), found))
        delta = new
    raise DatalogError(f"{group[0]} still improves after {max_rounds} rounds")
