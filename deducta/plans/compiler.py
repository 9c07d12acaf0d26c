"""Rules to DataFrame plans.

A relation is a DataFrame of distinct rows with columns c0, c1, ...; a relation without arguments has
the one column ``_unit``.  A body becomes a frame with a column for each variable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ast import Atom, Const, DatalogError, Rule, Struct, Var, aggregate_of

UNIT = "_unit"
Relations = dict[str, DataFrame]


def columns_of(arity: int) -> list[str]:
    return [f"c{k}" for k in range(arity)] or [UNIT]


def name(v: Var) -> str:
    return "v_" + v.name.replace("#", "n")


def kind(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.NumericType):
        return "number"
    return t.typeName()


def _kind_of(frame: DataFrame, term: Const | Var) -> str:
    if isinstance(term, Const):
        return "string" if isinstance(term.value, str) else "number"
    return kind(frame.schema[name(term)].dataType)


def scan(atom: Atom, relation: DataFrame) -> DataFrame:
    """The atom's distinct bindings: constants and repeated variables become filters on the scan."""
    first: dict[Var, str] = {}
    tests: list[Column] = []
    for column, arg in zip(relation.columns, atom.args, strict=False):
        if isinstance(arg, Const):
            same = kind(relation.schema[column].dataType) == ("string" if isinstance(arg.value, str) else "number")
            tests.append(F.col(column) == F.lit(arg.value) if same else F.lit(False))
        elif arg in first:
            same = kind(relation.schema[column].dataType) == kind(relation.schema[first[arg]].dataType)
            tests.append(F.col(column) == F.col(first[arg]) if same else F.lit(False))
        else:
            first[arg] = column
    if tests:
        relation = relation.where(reduce(Column.__and__, tests))
    if not first:
        return relation.select(F.lit(1).alias(UNIT)).limit(1)
    return relation.select(*(F.col(c).alias(name(v)) for v, c in first.items()))


def compare(frame: DataFrame, atom: Atom) -> Column:
    """The comparison as a column; values of different kinds are unequal and have no order."""
    a, b = atom.args
    if _kind_of(frame, a) != _kind_of(frame, b):
        if atom.pred in ("=", "!="):
            return F.lit(atom.pred == "!=")
        raise DatalogError(f"cannot order a number and a string: {atom}")
    x, y = (F.lit(t.value) if isinstance(t, Const) else F.col(name(t)) for t in (a, b))
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "=": x == y, "!=": x != y}[atom.pred]


def _join(frame: DataFrame, other: DataFrame, how: str) -> DataFrame:
    on = [c for c in other.columns if c in frame.columns and c != UNIT]
    for c in on:
        if kind(frame.schema[c].dataType) != kind(other.schema[c].dataType):
            return frame.where(F.lit(how == "left_anti")) if how != "inner" else frame.crossJoin(other.drop(*on)).where(F.lit(False))
    if on:
        return frame.join(other, on, how)
    if how == "inner":
        return frame.crossJoin(other.drop(UNIT) if len(other.columns) > 1 or UNIT not in other.columns else other.withColumnRenamed(UNIT, f"_u{len(frame.columns)}"))
    return frame.withColumn("_k", F.lit(1)).join(other.select(F.lit(1).alias("_k")).limit(1), "_k", how).drop("_k")


def body(rule: Rule, relations: Relations, delta: dict[int, DataFrame] | None = None, keep_all: bool = False) -> DataFrame:
    """A row for each solution of the body.

    delta replaces the relation of literals by their place in the body.  Literals are joined from the
    delta on, always to a connected one where there is any; a literal that binds nothing needed later
    is a semi-join, unless all variables are kept (aggregates count solutions).
    """
    delta = delta or {}
    todo = [(k, x) for k, x in enumerate(rule.body) if not x.negated and not x.atom.comparison]
    todo.sort(key=lambda kx: kx[0] not in delta)
    tests = list(rule.comparisons)
    wanted = {v for v in (rule.head.variables if rule.head else [])} | {v for x in rule.negative for v in x.atom.variables}
    frame: DataFrame | None = None
    bound: set[Var] = set()
    while todo:
        at = next((j for j, (_, x) in enumerate(todo) if frame is None or bound & set(x.atom.variables)), 0)
        k, x = todo.pop(at)
        rows = scan(x.atom, delta.get(k, relations[x.atom.pred]))
        if frame is None:
            frame = rows
        else:
            later = wanted | {v for _, y in todo for v in y.atom.variables} | {v for t in tests for v in t.atom.variables}
            new = set(x.atom.variables) - bound
            frame = _join(frame, rows, "inner" if keep_all or new & later else "left_semi")
        bound |= set(x.atom.variables)
        for t in [t for t in tests if set(t.atom.variables) <= bound]:
            frame = frame.where(compare(frame, t.atom))
            tests.remove(t)
    if frame is None:
        raise DatalogError(f"a rule needs a positive literal: {rule}")
    for x in rule.negative:
        frame = _join(frame, scan(x.atom, relations[x.atom.pred]), "left_anti")
    return frame


def _term(t: Const | Var) -> Column:
    return F.lit(t.value) if isinstance(t, Const) else F.col(name(t))


def derive(rule: Rule, relations: Relations, delta: dict[int, DataFrame] | None = None) -> DataFrame:
    """The head's rows, distinct but for those of aggregates, which already are."""
    head = rule.head
    if not rule.positive:
        raise DatalogError(f"a rule needs a positive literal: {rule}")
    folded = aggregate_of(head)
    frame = body(rule, relations, delta, keep_all=bool(folded))
    names = columns_of(len(head.args))
    if not folded:
        if not head.args:
            return frame.select(F.lit(1).alias(UNIT)).limit(1)
        return frame.select(*(_term(t).alias(c) for t, c in zip(head.args, names, strict=True))).distinct()
    place, function, v = folded
    value = F.col(name(v))
    is_text = kind(frame.schema[name(v)].dataType) == "string"
    if function == "sum" and is_text:
        raise DatalogError(f"sum needs numbers: {rule}")
    fold = {"count": F.count(F.lit(1)), "sum": F.sum(value), "min": F.min(value), "max": F.max(value)}[function]
    keys = [(t, c) for t, c in zip(head.args, names, strict=True) if not isinstance(t, Struct)]
    # an empty group has no row, even where nothing groups: hence the constant key
    groups = [_term(t).alias(c) for t, c in keys] or [F.lit(1).alias(UNIT)]
    out = frame.groupBy(*groups).agg(fold.alias(names[place]))
    return out.select(*names)


def facts_frame(spark, rows: list[tuple], arity: int) -> DataFrame:
    """Stated facts as a relation; every column must hold strings alone or numbers alone."""
    names = columns_of(arity)
    if not arity:
        return spark.range(1 if rows else 0).select(F.lit(1).alias(UNIT))
    fields = []
    for k, c in enumerate(names):
        kinds = {type(r[k]) for r in rows}
        if str in kinds and len(kinds) > 1:
            raise DatalogError(f"column {k + 1} mixes numbers and strings; use the local engine")
        fields.append(T.StructField(c, T.StringType() if str in kinds or not kinds else T.DoubleType() if float in kinds else T.LongType()))
    rows = [tuple(float(v) if isinstance(f.dataType, T.DoubleType) else v for v, f in zip(r, fields, strict=True)) for r in dict.fromkeys(rows)]
    return spark.createDataFrame(rows, T.StructType(fields))

