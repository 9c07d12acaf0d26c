"""Least fixpoints over DataFrames, one strongly connected component of predicates at a time.

Every round is one plan: the rules' new rows, less what is known.  Its result is checkpointed into
the shared folder, which keeps plans short and survives lost executors; what is known is the union of
those pieces, compacted every ``COMPACT`` rounds.
"""

from __future__ import annotations

import tempfile
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.local import Model, TooLarge
from ..plans.ast import Atom, Literal, Program, Rule, Var
from ..plans.compiler import Relations, columns_of, derive, facts_frame

COMPACT = 6
SMALL_ROWS = 20_000  # a recursive component that reads no more rows is evaluated in one place
SMALL_DERIVED = 200_000  # ... unless it derives more than so many


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; where it is unset, a temporary folder, in local mode alone."""
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="deducta-"))


def cut(df: DataFrame) -> DataFrame:
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def closure_doubled(rules: list[Rule]) -> list[Rule]:
    """A linear transitive closure as the one that joins itself: rounds grow with the logarithm of its depth."""
    if len(rules) != 2:
        return rules
    start, step = sorted(rules, key=lambda r: len(r.body))
    if len(start.body) != 1 or len(step.body) != 2 or any(x.negated or x.atom.comparison for r in rules for x in r.body):
        return rules
    p, (a, b), (e,) = start.head.pred, step.body, start.body
    if len(start.head.args) != 2 or start.head.args != e.atom.args or len(set(e.atom.variables)) != 2 or e.atom.pred == p:
        return rules
    if {a.atom.pred, b.atom.pred} != {p, e.atom.pred} or len(a.atom.args) != 2 or len(b.atom.args) != 2:
        return rules
    if a.atom.args[1] != b.atom.args[0]:
        a, b = b, a
    x, y, z = a.atom.args[0], a.atom.args[1], b.atom.args[1]
    if a.atom.args[1] != b.atom.args[0] or len({x, y, z}) != 3 or not all(isinstance(v, Var) for v in (x, y, z)) or step.head.args != (x, z):
        return rules
    return [start, Rule(step.head, (Literal(Atom(p, (x, y))), Literal(Atom(p, (y, z)))))]


class Fixpoint:
    """Evaluates a program's components over external relations.

    ``negated``: relations that ``not`` reads instead of the program's own (for alternating fixpoints).
    ``small_rows``: a round of jobs costs more than a small fixpoint, so a recursive component whose
    inputs are counted and found to have no more rows than this is evaluated in memory; it goes over to
    the distributed loop if it derives more than ``SMALL_DERIVED`` rows.  0: always distributed.
    ``log``: for each component and round: (predicates, round, predicates that grew); for one that was
    evaluated in memory: (predicates, 0, rows).
    """

    def __init__(self, spark: SparkSession, program: Program, external: Relations, naive: bool = False, negated: Relations | None = None, doubling: bool = True, small_rows: int | None = None):
        self.spark, self.program, self.naive, self.negated, self.doubling = spark, program, naive, negated, doubling
        self.small_rows = (SMALL_ROWS if small_rows is None else small_rows) if not naive and not negated else 0
        self.held: dict[str, list[tuple] | None] = {}  # rows of relations known to be small; None: not small
        self.plans: set[str] = set()  # input relations that are still plans over their source
        self.relations: Relations = {}
        self.log: list[tuple[tuple[str, ...], int, int]] = []
        stated: dict[str, list[tuple]] = {}
        for f in program.facts:
            stated.setdefault(f.head.pred, []).append(tuple(a.value for a in f.head.args))
        for pred, n in program.arity.items():
            parts = [facts_frame(spark, stated[pred], n)] if pred in stated else []
            if pred in external:
                parts.append(external[pred].toDF(*columns_of(n)).distinct())
                self.plans.add(pred)
            if parts:
                self.relations[pred] = parts[0] if len(parts) == 1 else union(parts).distinct()
            if pred not in external and pred not in program.derived and n:
                self.held[pred] = list(dict.fromkeys(stated.get(pred, ())))

    def _small(self, pred: str) -> list[tuple] | None:
        """The rows of a relation that has no more than ``small_rows``; they are counted as they come."""
        if pred not in self.held:
            rows = self.relations[pred].limit(self.small_rows + 1).collect() if self.program.arity[pred] else None
            self.held[pred] = [tuple(r) for r in rows] if rows is not None and len(rows) <= self.small_rows else None
        return self.held[pred]

    def _in_memory(self, group: list[str], rules: list[Rule], recursive: bool) -> bool:
        """Evaluate the component from small inputs; False if it is not small."""
        reads = {x.atom.pred for r in rules for x in r.body if not x.atom.comparison} | {p for p in group if p in self.relations}
        if not self.small_rows or any(not self.program.arity[p] for p in (*reads, *group)):
            return False
        if not recursive and any(p not in self.held for p in reads):
            return False  # one plan does it
        given, total = {}, 0
        for p in sorted(reads - (set(group) - self.relations.keys())):
            rows = self._small(p)
            if rows is None or (total := total + len(rows)) > self.small_rows:
                return False
            given[p] = rows
        try:
            model = Model(rules, given, total + SMALL_DERIVED)
        except TooLarge:
            return False
        for p in group:
            found = list(model.stores[p].rows)
            start = next((r for r in rules if r.head.pred == p and all(x.atom.pred in self.relations for x in r.body if not x.atom.comparison)), None)
            schema = self._derive(start).schema if start else facts_frame(self.spark, found[:1], self.program.arity[p]).schema
            columns = list(zip(*found, strict=True)) or [[] for _ in schema]
            arrow = to_arrow_schema(schema)
            self.relations[p] = self.spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), schema)
            self.held[p] = found if len(found) <= self.small_rows else None
        self.log.append((tuple(group), 0, sum(len(model.stores[p].rows) for p in group)))
        return True

    def _empty(self, pred: str, rules: list[Rule]) -> DataFrame:
        """An empty relation, its types taken from a rule where one can be planned, else strings."""
        for r in rules:
            if r.head.pred == pred and all(x.atom.pred in self.relations for x in r.body if not x.atom.comparison):
                return derive(r, self._reading(r)).limit(0)
        return facts_frame(self.spark, [], self.program.arity[pred])

    def _reading(self, rule: Rule) -> Relations:
        if not self.negated:
            return self.relations
        own = {x.atom.pred for x in rule.positive}
        return {**self.relations, **{p: d for p, d in self.negated.items() if p not in own}}

    def _derive(self, rule: Rule, delta: dict[int, DataFrame] | None = None) -> DataFrame:
        if self.negated and any(x.atom.pred in {y.atom.pred for y in rule.positive} for x in rule.negative):
            # a predicate read both ways: the negated reading gets a name of its own
            renamed = tuple(Literal(Atom("not " + x.atom.pred, x.atom.args), True) if x.negated else x for x in rule.body)
            reading = {**self.relations, **{"not " + p: d for p, d in self.negated.items()}}
            return derive(Rule(rule.head, renamed), reading, delta)
        return derive(rule, self._reading(rule), delta)

    def run(self) -> Relations:
        by_head: dict[str, list[Rule]] = {}
        for r in dict.fromkeys(self.program.rules):
            by_head.setdefault(r.head.pred, []).append(r)
        for p in self.program.arity:
            if p not in self.relations and p not in by_head:
                self.relations[p] = facts_frame(self.spark, [], self.program.arity[p])
        for group in self.program.components:
            rules = [r for p in group for r in by_head.get(p, [])]
            if rules:
                self._component(group, rules)
        return self.relations

    def _component(self, group: list[str], rules: list[Rule]) -> None:
        inside = set(group)
        recursive = [r for r in rules if any(x.atom.pred in inside for x in r.positive)]
        stated = {p: self.relations[p] for p in group if p in self.relations}
        start = [r for r in rules if r not in recursive]
        if self._in_memory(group, rules, bool(recursive)):
            return
        if not recursive:
            for p in group:
                parts = [self._derive(r) for r in start if r.head.pred == p] + ([stated[p]] if p in stated else [])
                rows = parts[0] if len(parts) == 1 else union(parts).distinct()
                self.relations[p] = cut(rows) if self._read_again(p) else rows
            return
        self._store({x.atom.pred for r in recursive for x in r.body if not x.atom.comparison} - inside)
        if self.doubling and not self.naive and not stated and len(group) == 1:
            rules = closure_doubled(rules)
            recursive = [r for r in rules if any(x.atom.pred in inside for x in r.positive)]
        self._seed(group, start, stated, recursive)
        (self._naive if self.naive else self._delta)(group, start, recursive)

    def _store(self, preds: set[str]) -> None:
        """Inputs that every round reads are derived from their source once."""
        for p in sorted(preds & self.plans):
            self.relations[p] = cut(self.relations[p])
            self.plans.discard(p)

    def _read_again(self, pred: str) -> bool:
        """Whether rules read the predicate several times, or in a loop; if not, it stays a plan that Catalyst
        can prune and push filters into."""
        home = {p: k for k, g in enumerate(self.program.components) for p in g}
        readers = [r for r in self.program.rules for x in r.body if not x.atom.comparison and x.atom.pred == pred]
        return len(readers) > 1 or any(home.get(x.atom.pred) == home[r.head.pred] for r in readers for x in r.body)

    def _seed(self, group: list[str], start: list[Rule], stated: Relations, recursive: list[Rule]) -> None:
        for p in group:
            parts = [self._derive(r) for r in start if r.head.pred == p] + ([stated[p]] if p in stated else [])
            if parts:
                self.relations[p] = cut(parts[0] if len(parts) == 1 else union(parts).distinct())
        waiting = [p for p in group if p not in self.relations]
        while waiting:  # types of predicates without a start come from rules over those that have one
            ready = [p for p in waiting if any(r.head.pred == p and all(x.atom.pred in self.relations for x in r.body if not x.atom.comparison) for r in recursive)]
            for p in ready or waiting:
                self.relations[p] = self._empty(p, recursive)
            waiting = [p for p in waiting if p not in self.relations]

    def _new(self, parts: list[DataFrame], known: DataFrame) -> DataFrame:
        rows = parts[0] if len(parts) == 1 else union(parts).distinct()
        return cut(rows.join(known, rows.columns, "left_anti"))

    def _delta(self, group: list[str], start: list[Rule], recursive: list[Rule]) -> None:
        delta = {p: self.relations[p] for p in group}
        turn = 0
        while delta:
            turn += 1
            new: Relations = {}
            for p in group:
                parts = [self._derive(r, {k: delta[x.atom.pred]}) for r in recursive if r.head.pred == p for k, x in enumerate(r.body) if not x.negated and x.atom.pred in delta]
                if parts:
                    rows = self._new(parts, self.relations[p])
                    if not rows.isEmpty():
                        new[p] = rows
            for p, rows in new.items():
                known = self.relations[p].union(rows)
                self.relations[p] = cut(known.coalesce(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))) if turn % COMPACT == 0 else known
            self.log.append((tuple(group), turn, len(new)))
            delta = new

    def _naive(self, group: list[str], start: list[Rule], recursive: list[Rule]) -> None:
        """All rules on all rows until nothing changes: the definition, for comparison."""
        turn = 0
        while True:
            turn += 1
            grown = {}
            for p in group:
                parts = [self._derive(r) for r in [*start, *recursive] if r.head.pred == p]
                rows = self._new(parts, self.relations[p]) if parts else None
                if rows is not None and not rows.isEmpty():
                    grown[p] = rows
            for p, rows in grown.items():
                self.relations[p] = cut(self.relations[p].union(rows))
            self.log.append((tuple(group), turn, len(grown)))
            if not grown:
                return

