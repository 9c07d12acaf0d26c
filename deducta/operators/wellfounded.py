"""Well-founded semantics over DataFrames, by alternating fixpoints."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.analysis import analyse, components, dependencies
from ..plans.ast import DatalogError, Rule, aggregate_of
from ..plans.compiler import Relations
from .fixpoint import Fixpoint, cut


def well_founded(spark: SparkSession, clauses: list[Rule], external: Relations | None = None) -> tuple[Relations, Relations]:
    """(true rows, undefined rows) of every predicate; negation may be recursive.

    ``not p`` reads a fixed relation in each inner fixpoint: under what surely holds, more than the
    truth is derived; under that, less; the two are repeated until the true rows stay.
    """
    external = {p: cut(d) for p, d in (external or {}).items()}  # every inner fixpoint reads them
    if any(c.head and aggregate_of(c.head) for c in clauses if c.body):
        raise DatalogError("aggregates have no well-founded meaning here")
    program = analyse([c for c in clauses if c.head], {p: len(d.columns) for p, d in external.items()}, stratified=False)
    # what is negated is fixed, so the components of the positive part are enough
    reads = {h: {(p, how) for p, how in e if how != "not"} for h, e in dependencies(program.rules).items()}
    program.components = components(reads)

    def least(negated: Relations | None) -> Relations:
        if negated is None:
            positive = [Rule(r.head, tuple(x for x in r.body if not x.negated)) for r in program.rules]
            open_ = analyse([*program.facts, *positive], {p: len(d.columns) for p, d in external.items()}, stratified=False)
            for p, n in program.arity.items():
                open_.arity.setdefault(p, n)
            return Fixpoint(spark, open_, external, doubling=False).run()
        return Fixpoint(spark, program, external, negated=negated, doubling=False).run()

    over = least(None)
    under = least(over)
    size = -1
    while True:
        over = least(under)
        under = least(over)
        now = sum(under[p].count() for p in program.derived)
        if now == size:
            break
        size = now
    undefined = {p: over[p].join(under[p], over[p].columns, "left_anti") for p in program.derived}
    return under, undefined
