"""Where relations come from: DataFrames, Python rows, program files, and generators."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Mapping
from functools import reduce
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ast import Atom, Const, DatalogError, Rule
from ..plans.compiler import UNIT, columns_of

_NAME = re.compile("[a-z][A-Za-z0-9_]*")
_HIDDEN = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"


def check_value(v: object) -> str | int | float:
    """A string, whole number or finite number; no hidden characters, no string with both quotes."""
    if isinstance(v, bool) or not isinstance(v, str | int | float):
        raise DatalogError(f"a value is a string or a number, not {v!r}")
    if isinstance(v, float) and not math.isfinite(v):
        raise DatalogError(f"{v} is not finite")
    if isinstance(v, str) and (any(unicodedata.category(c) in ("Cc", "Cf", "Zl", "Zp") for c in v) or ("'" in v and '"' in v)):
        raise DatalogError(f"a string that cannot be written down: {v!r}")
    return v


def python_facts(facts: Mapping[str, Iterable]) -> list[Rule]:
    """Facts from rows; a bare value is a row of one."""
    out = []
    for pred, rows in facts.items():
        if not _NAME.fullmatch(pred) or pred == "not":
            raise DatalogError(f"{pred!r} is not a predicate's name")
        for row in rows:
            values = row if isinstance(row, tuple | list) else (row,)
            out.append(Rule(Atom(pred, tuple(Const(check_value(v)) for v in values))))
    return list(dict.fromkeys(out))


class WithoutNulls(NamedTuple):
    """Rows from which those with nulls were already left out, so that nothing looks for them again."""

    rows: DataFrame


def relation(df: DataFrame | WithoutNulls, checked: bool = False) -> DataFrame:
    """A DataFrame as a relation: dates as ISO text, booleans as text, distinct rows.

    A null is no value and is refused.  Looking for one costs a job, unless the schema or ``WithoutNulls`` says
    that there is none.
    checked: fail on strings and numbers that the language could not print.
    """
    known = isinstance(df, WithoutNulls)
    df = df.rows if known else df
    columns = []
    for field, c in zip(df.schema, columns_of(len(df.columns)), strict=True):
        kind, x = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, T.BooleanType | T.DateType):
            x = x.cast("string")
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
            x = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif not isinstance(kind, T.StringType | T.NumericType):
            raise DatalogError(f"column {field.name} of type {kind.simpleString()} does not fit a relation; select others")
        if checked and isinstance(kind, T.StringType):
            bad = x.rlike(_HIDDEN) | (x.contains("'") & x.contains('"'))
            x = F.when(bad, F.raise_error(F.lit(f"{field.name}: a string that cannot be written down"))).otherwise(x)
        if checked and isinstance(kind, T.FloatType | T.DoubleType):
            x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit(f"{field.name}: not finite"))).otherwise(x)
        columns.append(x.alias(c))
    if not columns:
        raise DatalogError(f"a relation needs a column; for none, give {UNIT}")
    rows = df.select(*columns)
    nullable = [f.name for f in rows.schema if f.nullable and not known]
    if nullable and not rows.where(reduce(Column.__or__, (F.col(c).isNull() for c in nullable))).isEmpty():
        raise DatalogError(f"a relation of columns {', '.join(df.columns)} holds a null; drop such rows before")
    return rows.distinct()


def read_program(path: str) -> str:
    try:
        return Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise DatalogError(f"cannot read {path}: {e.strerror}") from e
    except UnicodeDecodeError as e:
        raise DatalogError(f"{path} is not text") from e


# ---------------------------------------------------------------- generators


def chain(spark: SparkSession, n: int) -> DataFrame:
    """Edges n1 -> n2 -> ... of a chain of n nodes."""
    return spark.range(1, n).selectExpr("concat('n', id) AS c0", "concat('n', id + 1) AS c1")


def tree(spark: SparkSession, depth: int, fan: int = 2) -> DataFrame:
    """Edges of a full tree from parents to children."""
    nodes = (fan ** (depth + 1) - 1) // (fan - 1) if fan > 1 else depth + 1
    return spark.range(1, nodes).selectExpr(f"concat('n', (id - 1) div {fan}) AS c0", "concat('n', id) AS c1")


def clique(spark: SparkSession, n: int) -> DataFrame:
    pairs = spark.range(n * n).selectExpr(f"id div {n} AS a", f"id % {n} AS b").where("a != b")
    return pairs.selectExpr("concat('n', a) AS c0", "concat('n', b) AS c1")


def grid(spark: SparkSession, n: int) -> DataFrame:
    """Edges to the right and down of an n by n grid."""
    cells = spark.range(n * n).selectExpr(f"id div {n} AS r", f"id % {n} AS c")
    right = cells.where(f"c + 1 < {n}").selectExpr("concat('n', r, '_', c) AS c0", "concat('n', r, '_', c + 1) AS c1")
    down = cells.where(f"r + 1 < {n}").selectExpr("concat('n', r, '_', c) AS c0", "concat('n', r + 1, '_', c) AS c1")
    return right.union(down)


def queens(n: int) -> str:
    """Facts of the n-queens program: rows, distances, attacks."""
    out = [f"row({r})." for r in range(1, n + 1)] + [f"dist({d})." for d in range(1, n)]
    for d in range(1, n):
        out += [f"attacks({a}, {b}, {d})." for a in range(1, n + 1) for b in {a, a + d, a - d} if 1 <= b <= n]
    return "\n".join(out)


def ontology(n: int) -> str:
    """A chain of concepts with a role at every third."""
    out = ["role(r)."]
    for k in range(n):
        out.append(f"isa(c{k}, c{k + 1}).")
        if k % 3 == 0:
            out.append(f"isa(c{k}, some(r, c{k + 1})).")
    return "\n".join(out)
