"""Materialised programs under inserts and deletes of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.analysis import analyse
from ..plans.ast import DatalogError, Program, Rule, aggregate_of
from ..plans.compiler import Relations, columns_of, derive
from ..plans.parser import parse
from ..sources.facts import relation
from .fixpoint import COMPACT, Fixpoint, cut, union


class Materialized:
    """Positive rules kept up to date; ``base`` holds the stated rows, ``relations`` all rows."""

    def __init__(self, spark: SparkSession, text: str | list[Rule], facts: dict[str, DataFrame] | None = None):
        self.spark = spark
        clauses = parse(text) if isinstance(text, str) else text
        if any(r.negative or (r.head and r.body and aggregate_of(r.head)) or r.weight is not None for r in clauses):
            raise DatalogError("maintenance takes neither negation, aggregates nor weights")
        external = {p: relation(d) for p, d in (facts or {}).items()}
        self.program = analyse(clauses, {p: len(d.columns) for p, d in external.items()})
        run = Fixpoint(spark, self.program, external)
        self.base: Relations = {p: cut(d) for p, d in run.relations.items()}
        run.relations = dict(self.base)
        run.plans.clear()
        self.relations = run.run()
        for p in self.program.arity:
            self.base.setdefault(p, self.relations[p].limit(0))

    def _rows(self, x: dict[str, DataFrame] | str, retract: bool) -> Relations:
        if isinstance(x, str):
            clauses = parse(x)
            if any(c.body or c.head is None for c in clauses):
                raise DatalogError("an update has facts alone")
            return Fixpoint(self.spark, Program([Rule(c.head) for c in clauses], [], [], {c.head.pred: len(c.head.args) for c in clauses}), {}).relations
        return {p: d.toDF(*columns_of(len(d.columns))).distinct() for p, d in x.items()}

    def _spread(self, delta: Relations, into: Relations, known: Relations, keep: Relations | None = None) -> Relations:
        """All rows that follow from the delta by rules over ``known`` and are not in ``into`` yet."""
        found: Relations = {}
        turn = 0
        while delta:
            turn += 1
            new: Relations = {}
            for r in self.program.rules:
                parts = [derive(r, known, {k: delta[x.atom.pred]}) for k, x in enumerate(r.body) if not x.atom.comparison and x.atom.pred in delta]
                if parts:
                    p = r.head.pred
                    rows = union(parts).distinct()
                    if keep is not None:
                        rows = rows.join(keep[p], rows.columns, "left_semi") if p in keep else rows.limit(0)
                    new[p] = rows if p not in new else new[p].union(rows).distinct()
            delta = {}
            for p, rows in new.items():
                fresh = cut(rows.join(into[p], rows.columns, "left_anti"))
                if not fresh.isEmpty():
                    delta[p] = fresh
                    found[p] = fresh if p not in found else found[p].union(fresh)
                    into[p] = into[p].union(fresh)
                    if turn % COMPACT == 0:
                        into[p] = cut(into[p].coalesce(int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        return found

    def insert(self, rows: dict[str, DataFrame] | str) -> dict[str, int]:
        """Add facts; semi-naive evaluation goes on from them.  Counts: inserted, derived."""
        new = {p: cut(d.join(self.base[p], d.columns, "left_anti")) for p, d in self._rows(rows, False).items()}
        inserted = sum(d.count() for d in new.values())
        delta = {}
        for p, d in new.items():
            self.base[p] = cut(self.base[p].union(d))
            fresh = cut(d.join(self.relations[p], d.columns, "left_anti"))
            if not fresh.isEmpty():
                delta[p] = fresh
                self.relations[p] = self.relations[p].union(fresh)
        found = self._spread(delta, self.relations, self.relations)
        derived = sum(d.count() for d in found.values())
        self.relations = {p: cut(d) if p in found or p in delta else d for p, d in self.relations.items()}
        return {"inserted": inserted, "derived": derived}

    def delete(self, rows: dict[str, DataFrame] | str, how: str = "dred") -> dict[str, int]:
        """Take facts away.

        dred: delete all that depends on them, then derive again what has another reason.
        bf: find what is affected, keep what is supported by the rest, and remove the others.
        """
        if how not in ("dred", "bf"):
            raise DatalogError(f"delete by dred or bf, not {how}")
        gone = self._rows(rows, True)
        for p, d in gone.items():
            if not d.join(self.base[p], d.columns, "left_anti").isEmpty():
                raise DatalogError(f"only stated facts of {p} can be deleted")
        deleted = sum(d.count() for d in gone.values())
        for p, d in gone.items():
            self.base[p] = cut(self.base[p].join(d, d.columns, "left_anti"))
        # over-delete on the relations as they were
        affected: Relations = {p: d.limit(0) for p, d in self.relations.items()}
        start = {}
        for p, d in gone.items():
            start[p] = cut(d)
            affected[p] = affected[p].union(start[p])
        self._spread(start, affected, dict(self.relations))
        affected = {p: cut(d) for p, d in affected.items()}
        over = sum(d.count() for d in affected.values())
        rest = {p: cut(d.join(affected[p], d.columns, "left_anti")) for p, d in self.relations.items()}
        # what is still stated, or follows in one step from the rest, comes back; then all that follows from it
        back: Relations = {}
        for p in self.program.arity:
            parts = [self.base[p].join(affected[p], affected[p].columns, "left_semi")]
            parts += [derive(r, rest).join(affected[p], affected[p].columns, "left_semi") for r in self.program.rules if r.head.pred == p]
            again = cut(union(parts).distinct())
            if not again.isEmpty():
                back[p] = again
        for p, d in back.items():
            rest[p] = rest[p].union(d)
        again = self._spread(dict(back), rest, rest)
        confirmed = sum(d.count() for d in back.values()) + sum(d.count() for d in again.values())
        self.relations = {p: cut(d) for p, d in rest.items()}
        if how == "bf":
            return {"deleted": deleted, "affected": over, "confirmed": confirmed, "removed": over - confirmed}
        return {"deleted": deleted, "over_deleted": over, "rederived": confirmed, "net_removed": over - confirmed}

    def apply(self, script: str, how: str = "dred") -> list[dict[str, int]]:
        """A script of facts (inserted) and retracted facts (deleted first)."""
        clauses = parse(script)
        analyse([Rule(c.head, c.body) for c in clauses], dict(self.program.arity))
        out = []
        for retract in (True, False):
            text = "\n".join(str(Rule(c.head)) for c in clauses if c.retract == retract)
            if text:
                out.append(self.delete(text, how) if retract else self.insert(text))
        return out
