"""Programs over Spark: load facts, evaluate, ask."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.fixpoint import Fixpoint, cut
from .operators.wellfounded import well_founded
from .plans.analysis import analyse, dependencies
from .plans.ast import Atom, Const, DatalogError, Literal, Rule, Var
from .plans.compiler import UNIT, Relations, body, name, scan
from .plans.magic import demand
from .plans.parser import parse, parse_goal
from .sources.facts import WithoutNulls, python_facts, relation

Facts = Mapping[str, DataFrame | WithoutNulls | Iterable]


def split_facts(facts: Facts | None) -> tuple[list[Rule], Relations]:
    """Stated facts and external relations of a mapping of rows or DataFrames."""
    rows, frames = {}, {}
    for p, x in (facts or {}).items():
        (frames if isinstance(x, DataFrame | WithoutNulls) else rows)[p] = x
    return python_facts(rows), {p: relation(d) for p, d in frames.items()}


def assume(clauses: list[Rule], script: str) -> list[Rule]:
    """The clauses with the script's facts added and its retracted facts taken away."""
    out = list(clauses)
    for c in parse(script):
        if c.body or c.head is None:
            raise DatalogError(f"only facts can be assumed: {c}")
        if not c.retract:
            out.append(c)
            continue
        kept = [r for r in out if r.body or r.head != c.head]
        if len(kept) == len(out):
            raise DatalogError(f"{c.head} is not stated, so it cannot be retracted")
        out = kept
    return list(dict.fromkeys(out))


def check_query(atom: Atom, arity: Mapping[str, int]) -> Atom:
    if atom.pred not in arity:
        raise DatalogError(f"nothing defines {atom.pred}")
    if arity[atom.pred] != len(atom.args):
        raise DatalogError(f"{atom.pred} has {arity[atom.pred]} arguments: {atom}")
    return atom


def answers_frame(atom: Atom, rows: DataFrame) -> DataFrame:
    """Distinct bindings of the named variables; one column ``_unit`` if there are none."""
    found = scan(atom, rows)
    named = [v for v in atom.variables if not v.anonymous]
    if not named:
        return found.select(F.lit(1).alias(UNIT)).limit(1)
    return found.select(*(F.col(name(v)).alias(v.name) for v in named)).distinct()


class Engine:
    """Bottom-up evaluation of a whole program; relations are computed when first asked for."""

    naive = False
    goal_directed = False

    def __init__(self, spark: SparkSession, text: str | list[Rule], facts: Facts | None = None, doubling: bool = True, small_rows: int | None = None):
        self.spark = spark
        stated, self.external = split_facts(facts)
        self.clauses = list(dict.fromkeys([*(parse(text) if isinstance(text, str) else text), *stated]))
        self.program = analyse(self.clauses, {p: len(d.columns) for p, d in self.external.items()})
        self.doubling, self.small_rows = doubling, small_rows
        self.log: list = []
        self._relations: Relations | None = None

    @property
    def relations(self) -> Relations:
        if self._relations is None:
            run = Fixpoint(self.spark, self.program, self.external, self.naive, doubling=self.doubling, small_rows=self.small_rows)
            self._relations = run.run()
            self.log = run.log
        return self._relations

    def relation(self, pred: str) -> DataFrame:
        if pred not in self.program.arity:
            raise DatalogError(f"nothing defines {pred}")
        return self.relations[pred]

    def _rows(self, atom: Atom) -> DataFrame:
        return self.relation(atom.pred)

    def query(self, goal: str | Atom) -> DataFrame:
        """Distinct bindings of the goal's named variables, a column each."""
        atom = check_query(parse_goal(goal) if isinstance(goal, str) else goal, self.program.arity)
        return answers_frame(atom, self._rows(atom))

    def answers(self, goal: str | Atom) -> DataFrame:
        """Whole rows of the goal's relation that match it."""
        atom = check_query(parse_goal(goal) if isinstance(goal, str) else goal, self.program.arity)
        rows = self._rows(atom)
        return rows.where(_same(rows, atom)) if atom.args else rows

    def violations(self) -> list[tuple[Rule, DataFrame]]:
        """For each constraint, the distinct bindings of its named variables that break it."""
        out = []
        for c in self.program.constraints:
            rows = body(c, self.relations, keep_all=True)
            named = [v for v in {v: None for x in c.positive for v in x.atom.variables} if not v.anonymous]
            columns = [F.col(name(v)).alias(v.name) for v in named] or [F.lit(1).alias(UNIT)]
            out.append((c, rows.select(*columns).distinct()))
        return out


def _same(rows: DataFrame, atom: Atom) -> Column:
    """Whether a row matches the atom."""
    tests, first = [F.lit(True)], {}
    for c, a in zip(rows.columns, atom.args, strict=True):
        if isinstance(a, Const):
            tests.append(F.col(c) == F.lit(a.value))
        elif a in first:
            tests.append(F.col(c) == F.col(first[a]))
        else:
            first[a] = c
    return reduce(Column.__and__, tests)


class NaiveEngine(Engine):
    """All rules on all rows, every round."""

    naive = True


class MagicEngine(Engine):
    """Each query derives only what it can reach."""

    goal_directed = True

    def _rows(self, atom: Atom) -> DataFrame:
        return self._evaluate([c for c in self.clauses if c.head], atom)

    def _evaluate(self, clauses: list[Rule], atom: Atom) -> DataFrame:
        clauses, pred = demand(clauses, atom, set(self.external))
        read = {x.atom.pred for c in clauses for x in c.body} | {pred}
        external = {name_: d for p, d in self.external.items() for name_ in (p, "external#" + p) if name_ in read}
        program = analyse(clauses, {p: len(d.columns) for p, d in external.items()})
        run = Fixpoint(self.spark, program, external, doubling=False, small_rows=self.small_rows)
        found = run.run()
        self.log = run.log
        return found[pred]


    def violations(self) -> list[tuple[Rule, DataFrame]]:
        """For each constraint, the bindings that break it: a goal of its own, which derives only what it can reach."""
        out = []
        for k, c in enumerate(self.program.constraints):
            named = [v for v in {v: None for x in c.positive for v in x.atom.variables} if not v.anonymous]
            goal = Atom(f"constraint#{k}", tuple(named) or (Const(1),))
            clauses = [x for x in self.clauses if x.head] + [Rule(goal, c.body)]
            rows = self._evaluate(clauses, goal)
            out.append((c, rows.toDF(*(v.name for v in named)) if named else rows.select(F.lit(1).alias(UNIT))))
        return out


class TabledEngine(MagicEngine):
    """Demand-driven answers that are kept by call pattern; a more general table serves a special call."""

    def __init__(self, *args, **kw):
        super().__init__(*args, **kw)
        self.tables: dict[tuple, DataFrame] = {}

    @staticmethod
    def _key(atom: Atom) -> tuple:
        places: dict[Var, int] = {}
        return (atom.pred, *(("v", places.setdefault(a, len(places))) if isinstance(a, Var) else ("c", a.value) for a in atom.args))

    def _rows(self, atom: Atom) -> DataFrame:
        key = self._key(atom)
        for k, rows in self.tables.items():
            wider = k[0] == key[0] and all(a == b or a[0] == "v" for a, b in zip(k[1:], key[1:], strict=True))
            if wider and len({a[1] for a in k[1:] if a[0] == "v"}) == sum(a[0] == "v" for a in k[1:]):
                return rows
        self.tables[key] = rows = cut(super()._rows(atom))
        return rows

    def apply(self, script: str) -> int:
        """Update the stated facts; tables that depend on a changed predicate are dropped.  Returns how many."""
        changed = {c.head.pred for c in parse(script)}
        self.clauses = assume(self.clauses, script)
        self.program = analyse(self.clauses, {p: len(d.columns) for p, d in self.external.items()})
        reads = dependencies(self.program.rules)
        grown = True
        while grown:
            more = {h for h, r in reads.items() if any(p in changed for p, _ in r)} - changed
            changed, grown = changed | more, bool(more)
        lost = [k for k in self.tables if k[0] in changed]
        for k in lost:
            del self.tables[k]
        self._relations = None
        return len(lost)


class SlgEngine:
    """Answers under the well-founded semantics: negation may be recursive.

    Only the rules that the goal's predicate reads are evaluated.  ``query`` gives the true and the
    undefined bindings; ``violations`` the same for each constraint.
    """

    goal_directed = True

    def __init__(self, spark: SparkSession, text: str | list[Rule], facts: Facts | None = None):
        self.spark = spark
        stated, self.external = split_facts(facts)
        self.clauses = list(dict.fromkeys([*(parse(text) if isinstance(text, str) else text), *stated]))
        self.program = analyse(self.clauses, {p: len(d.columns) for p, d in self.external.items()}, stratified=False)

    def _model(self, preds: set[str]) -> tuple[Relations, Relations]:
        reads = {p: {x.atom.pred for r in self.program.rules if r.head.pred == p for x in r.body if not x.atom.comparison} for p in self.program.arity}
        todo, reach = list(preds), set()
        while todo:
            p = todo.pop()
            if p not in reach:
                reach.add(p)
                todo += reads.get(p, ())
        clauses = [c for c in self.clauses if c.head and c.head.pred in reach]
        true, undefined = well_founded(self.spark, clauses, {p: d for p, d in self.external.items() if p in reach})
        return true, undefined

    def query(self, goal: str | Atom) -> tuple[DataFrame, DataFrame]:
        atom = check_query(parse_goal(goal) if isinstance(goal, str) else goal, self.program.arity)
        true, undefined = self._model({atom.pred})
        rows = true[atom.pred]
        return answers_frame(atom, rows), answers_frame(atom, undefined.get(atom.pred, rows.limit(0)))

    def violations(self) -> list[tuple[Rule, DataFrame, DataFrame]]:
        """For each constraint, what breaks it for sure, and what may."""
        preds = {x.atom.pred for c in self.program.constraints for x in c.body if not x.atom.comparison}
        true, undefined = self._model(preds)
        open_ = {p: true[p].union(undefined[p]) if p in undefined else true[p] for p in true}
        out = []
        for c in self.program.constraints:
            sure = Rule(None, c.body)
            marked = {**true, **{"not " + p: d for p, d in open_.items()}}
            loose = {**open_, **{"not " + p: d for p, d in true.items()}}
            renamed = Rule(None, tuple(Literal(Atom("not " + x.atom.pred, x.atom.args), True) if x.negated else x for x in sure.body))
            named = [v for v in {v: None for x in c.positive for v in x.atom.variables} if not v.anonymous]
            columns = [F.col(name(v)).alias(v.name) for v in named] or [F.lit(1).alias(UNIT)]
            bad, may = (body(renamed, r, keep_all=True).select(*columns).distinct() for r in (marked, loose))
            out.append((c, bad, may.join(bad, bad.columns, "left_anti")))
        return out


def run_program(spark: SparkSession, text: str, facts: Facts | None = None, engine: str = "seminaive") -> Engine:
    """Parse, check and prepare a program with facts from text, Python rows or DataFrames."""
    return ENGINES[engine](spark, text, facts)


ENGINES: dict[str, type] = {"seminaive": Engine, "naive": NaiveEngine, "magic": MagicEngine, "tabling": TabledEngine, "slg": SlgEngine}
