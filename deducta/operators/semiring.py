"""Annotated relations: every row carries a value of a semiring in the column ``_k``.

Joins multiply, duplicate derivations add, rounds repeat until no value changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ast import Atom, Const, DatalogError, Rule, Struct, format_fact
from ..plans.analysis import analyse
from ..plans.compiler import columns_of, compare, facts_frame, name
from .fixpoint import COMPACT, cut, union

K = "_k"


class Semiring:
    """What a user defines: the type, how alternatives add and joined values multiply, a fact's value."""

    name = "abstract"
    sql_type = "double"
    divergence = "its values keep changing"
    idempotent = False  # whether a + a = a: if so, rounds go on from what changed

    def plus(self, k: Column) -> Column:
        """An aggregate over the alternatives of one row."""
        raise NotImplementedError

    def times(self, a: Column, b: Column) -> Column:
        raise NotImplementedError

    def one(self) -> Column:
        return F.lit(1).cast(self.sql_type)

    def fact(self, weight: Column, token: Column) -> Column:
        """Value of a stated row: its weight (null if it has none), or of its printed form."""
        return F.coalesce(weight.cast(self.sql_type), self.one())

    def keep(self, k: Column) -> Column:
        """Whether the value is not zero."""
        return k.isNotNull()


class Boolean(Semiring):
    name, sql_type, idempotent = "bool", "boolean", True

    def plus(self, k):
        return F.bool_or(k)

    def times(self, a, b):
        return a & b

    def one(self):
        return F.lit(True)

    def fact(self, weight, token):
        return F.lit(True)


class MinPlus(Semiring):
    """Cheapest derivation."""

    name, divergence, idempotent = "minplus", "a cycle of negative weight lowers it for ever", True

    def plus(self, k):
        return F.min(k)

    def times(self, a, b):
        return a + b

    def one(self):
        return F.lit(0).cast(self.sql_type)


class Count(Semiring):
    """Number of derivations; weights do not matter."""

    name, sql_type, divergence = "count", "decimal(38,0)", "a cycle has infinitely many derivations"

    def plus(self, k):
        return F.sum(k).cast(self.sql_type)

    def times(self, a, b):
        return (a * b).cast(self.sql_type)

    def fact(self, weight, token):
        return self.one()


class Viterbi(Semiring):
    """Likeliest derivation."""

    name, idempotent = "viterbi", True

    def plus(self, k):
        return F.max(k)

    def times(self, a, b):
        return a * b

    def fact(self, weight, token):
        w = F.coalesce(weight.cast("double"), F.lit(1.0))
        return F.when((w >= 0) & (w <= 1), w).otherwise(F.raise_error(F.lit("a probability lies between 0 and 1")).cast("double"))

    def keep(self, k):
        return k > 0


class Why(Semiring):
    """Minimal sets of facts that suffice."""

    name, sql_type, idempotent = "why", "array<array<string>>", True

    @staticmethod
    def _minimal(sets: Column) -> Column:
        once = F.array_distinct(sets)
        smaller = lambda x: F.exists(once, lambda y: (F.size(y) < F.size(x)) & (F.size(F.array_except(y, x)) == 0))
        return F.array_sort(F.filter(once, lambda x: ~smaller(x)))

    def plus(self, k):
        return self._minimal(F.flatten(F.collect_list(k)))

    def times(self, a, b):
        return self._minimal(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array_sort(F.array_union(x, y))))))

    def one(self):
        return F.array(F.array().cast("array<string>"))

    def fact(self, weight, token):
        return F.array(F.array(token))


SEMIRINGS: dict[str, type[Semiring]] = {s.name: s for s in (Boolean, MinPlus, Count, Viterbi, Why)}


class SemiringEngine:
    """Kleene iteration of positive rules over annotated relations.

    facts: DataFrames whose last column ``_w`` is the weight (null or absent: none).  Values of equal
    rows add.  Where sums are idempotent, a round joins what the last one changed, and known values are kept
    as pieces that add up; else a round starts from all values.  A count over cyclic data, or a negative
    cycle, is reported once values still change after more rounds than there are rows.
    """

    def __init__(self, spark: SparkSession, clauses: list[Rule], semiring: Semiring | str, facts: dict[str, DataFrame] | None = None, max_rounds: int = 200):
        self.spark, self.max_rounds = spark, max_rounds
        self.s = SEMIRINGS[semiring]() if isinstance(semiring, str) else semiring
        if any(r.negative or r.constraint or any(isinstance(a, Struct) for a in r.head.args) for r in clauses):
            raise DatalogError("annotated evaluation takes neither negation nor aggregates nor constraints")
        external = facts or {}
        self._external = set(external)
        self.program = analyse(clauses, {p: len([c for c in d.columns if c != "_w"]) for p, d in external.items()})
        self.base = {p: self._stated(p, external.get(p)) for p in self.program.arity}
        looped = {p for p in external for r in self.program.rules if any(x.atom.pred == p for x in r.positive) and self._loops(r)}
        self.base |= {p: cut(self.base[p]) for p in looped}

    def _stated(self, pred: str, df: DataFrame | None) -> DataFrame:
        arity = self.program.arity[pred]
        names = columns_of(arity)
        weights: dict[tuple, set] = {}
        for f in self.program.facts:
            if f.head.pred == pred:
                weights.setdefault(tuple(a.value for a in f.head.args), {})[f.weight] = None
        parts = []
        by_weight: dict[object, list[tuple]] = {}
        for values, found in weights.items():
            for w in found:
                by_weight.setdefault(w, []).append(values)
        for w, rows in by_weight.items():
            parts.append(facts_frame(self.spark, rows, arity).withColumn("_w", F.lit(w).cast("double")).withColumn("_t", F.lit(None).cast("string")))
            if self.s.name == "why":
                for values in rows:
                    parts.append(facts_frame(self.spark, [values], arity).withColumn("_w", F.lit(w).cast("double")).withColumn("_t", F.lit(format_fact(pred, values)[:-1])))
                parts.pop(-len(rows) - 1)
        if df is not None:
            kept = [c for c in df.columns if c != "_w"]
            w = F.col("_w").cast("double") if "_w" in df.columns else F.lit(None).cast("double")
            token = F.concat(F.lit(pred + "("), F.concat_ws(", ", *(F.col(c).cast("string") for c in kept)), F.lit(")"))
            parts.append(df.select(*(F.col(c).alias(n) for c, n in zip(kept, names, strict=True)), w.alias("_w"), token.alias("_t")).distinct())
        if not parts:
            return facts_frame(self.spark, [], arity).withColumn(K, self.s.one()).limit(0)
        rows = union(parts).withColumn(K, self.s.fact(F.col("_w"), F.col("_t")))
        return rows.groupBy(*names).agg(self.s.plus(F.col(K)).alias(K))

    def _loops(self, rule: Rule) -> bool:
        home = next(g for g in self.program.components if rule.head.pred in g)
        return any(x.atom.pred in home for x in rule.positive)

    def _body(self, rule: Rule, values: dict[str, DataFrame], delta: dict[int, DataFrame] | None = None) -> DataFrame:
        """Solutions of the body; ``delta`` replaces relations of positive literals by their place, and is joined first."""
        frame, bound, delta = None, set(), delta or {}
        todo, tests, at = sorted(enumerate(rule.positive), key=lambda kx: kx[0] not in delta), list(rule.comparisons), 0
        while todo:
            j = next((j for j, (_, x) in enumerate(todo) if frame is None or bound & set(x.atom.variables)), 0)
            k, x = todo.pop(j)
            rel = delta.get(k, values[x.atom.pred])
            marked = Atom(x.atom.pred, x.atom.args)
            rows = self._scan(marked, rel, f"_k{at}")
            if frame is None:
                frame = rows.withColumnRenamed(f"_k{at}", K)
            else:
                on = [c for c in rows.columns if c in frame.columns and c.startswith("v_")]
                frame = (frame.join(rows, on) if on else frame.crossJoin(rows)).withColumn(K, self.s.times(F.col(K), F.col(f"_k{at}"))).drop(f"_k{at}")
            at += 1
            bound |= set(x.atom.variables)
            for t in [t for t in tests if set(t.atom.variables) <= bound]:
                frame = frame.where(compare(frame, t.atom))
                tests.remove(t)
        return frame

    @staticmethod
    def _scan(atom: Atom, relation: DataFrame, k: str) -> DataFrame:
        tests, first = [F.lit(True)], {}
        for c, a in zip(columns_of(len(atom.args)), atom.args, strict=False):
            if isinstance(a, Const):
                tests.append(F.col(c) == F.lit(a.value))
            elif a in first:
                tests.append(F.col(c) == F.col(first[a]))
            else:
                first[a] = c
        return relation.where(reduce(Column.__and__, tests)).select(*(F.col(c).alias(name(v)) for v, c in first.items()), F.col(K).alias(k))

    def _round(self, values: dict[str, DataFrame], group: list[str], rules: list[Rule]) -> dict[str, DataFrame]:
        out = {}
        for p in group:
            names = columns_of(self.program.arity[p])
            parts = [self.base[p]] if self._has_base(p) else []
            for r in rules:
                if r.head.pred == p and all(x.atom.pred in values for x in r.positive):
                    parts.append(self._heads(r, values))
            if parts:
                rows = union(parts).groupBy(*names).agg(self.s.plus(F.col(K)).alias(K)).where(self.s.keep(F.col(K)))
                out[p] = cut(rows)
        return out

    def _heads(self, rule: Rule, values: dict[str, DataFrame], delta: dict[int, DataFrame] | None = None) -> DataFrame:
        names = columns_of(self.program.arity[rule.head.pred])
        head = [(F.lit(a.value) if isinstance(a, Const) else F.col(name(a))).alias(c) for a, c in zip(rule.head.args, names, strict=False)] or [F.lit(1).alias(names[0])]
        return self._body(rule, values, delta).select(*head, K)

    def _total(self, pieces: DataFrame, p: str) -> DataFrame:
        return pieces.groupBy(*columns_of(self.program.arity[p])).agg(self.s.plus(F.col(K)).alias(K))

    def _improved(self, found: DataFrame, known: DataFrame | None, p: str) -> DataFrame:
        """Rows whose value the found alternatives change, with the new value: one shuffle of known and found."""
        found = found.where(self.s.keep(F.col(K)))
        if known is None:
            return cut(self._total(found, p))
        names = columns_of(self.program.arity[p])
        both = known.withColumn("_old", F.lit(True)).union(found.withColumn("_old", F.lit(False)))
        sums = both.groupBy(*names).agg(self.s.plus(F.col(K)).alias("_new"), self.s.plus(F.when(F.col("_old"), F.col(K))).alias("_before"), F.bool_or("_old").alias("_was"))
        return cut(sums.where(~F.col("_was") | ~F.col("_new").eqNullSafe(F.col("_before"))).select(*names, F.col("_new").alias(K)))

    def _from_changes(self, values: dict[str, DataFrame], group: list[str], rules: list[Rule]) -> dict[str, DataFrame]:
        """The component's values by rounds over what changed; sums are idempotent, so pieces of old values do no harm."""
        delta = self._round(values, group, [r for r in rules if not self._loops(r)])
        pieces, turn = dict(delta), 0
        while delta:
            turn += 1
            reading = {**values, **{p: self._total(d, p) for p, d in pieces.items()}}
            new = {}
            for p in group:
                parts = [
                    self._heads(r, reading, {k: delta[x.atom.pred]})
                    for r in rules
                    if r.head.pred == p and all(x.atom.pred in reading for x in r.positive)
                    for k, x in enumerate(r.positive)
                    if x.atom.pred in delta
                ]
                if parts:
                    changed = self._improved(union(parts), pieces.get(p), p)
                    if not changed.isEmpty():
                        new[p] = changed
            for p, d in new.items():
                pieces[p] = pieces[p].union(d) if p in pieces else d
            if turn % COMPACT == 0:
                pieces |= {p: cut(self._total(d, p)) for p, d in pieces.items()}
                if new and turn > sum(d.count() for d in pieces.values()) + 1:
                    self._diverges(group)
            if new and turn > self.max_rounds:
                self._diverges(group)
            delta = new
        return {p: cut(self._total(d, p)) for p, d in pieces.items()}

    def _diverges(self, group: list[str]) -> None:
        raise DatalogError(f"{group[0]} has no value under {self.s.name}: {self.s.divergence}")

    def _has_base(self, p: str) -> bool:
        return p in self._stated_preds

    def run(self) -> dict[str, DataFrame]:
        derived = self.program.derived
        self._stated_preds = {f.head.pred for f in self.program.facts} | {p for p in self.base if p not in derived} | self._external
        values = {p: d for p, d in self.base.items() if p not in derived}
        rules = list(dict.fromkeys(self.program.rules))
        for group in self.program.components:
            own = [r for r in rules if r.head.pred in group]
            if not own:
                continue
            loop = any(x.atom.pred in group for r in own for x in r.positive)
            if loop and self.s.idempotent:
                now = self._from_changes(values, group, own)
                values |= {p: now.get(p, self.base[p]) for p in group}
                continue
            now: dict[str, DataFrame] = {}
            turn = 0
            while True:
                turn += 1
                new = self._round({**values, **now}, group, own)
                done = not loop or self._same(now, new)
                now = new
                if done:
                    break
                if turn > min(self.max_rounds, sum(d.count() for d in now.values()) + 1):
                    self._diverges(group)
            for p in group:
                values[p] = now.get(p, self.base[p])
        return values

    @staticmethod
    def _same(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> bool:
        if a.keys() != b.keys():
            return False
        return all(b[p].exceptAll(a[p].select(b[p].columns)).isEmpty() and a[p].count() == b[p].count() for p in b)
