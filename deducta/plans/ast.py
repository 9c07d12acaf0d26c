"""Terms, atoms, rules and the errors of the rule language."""

from __future__ import annotations

from dataclasses import dataclass, field

COMPARISONS = ("<=", ">=", "!=", "<", ">", "=")
AGGREGATES = ("count", "sum", "min", "max")


class DatalogError(Exception):
    """Anything wrong with a program, its facts or a query."""


class ParseError(DatalogError):
    """The text is not a program."""


class SafetyError(DatalogError):
    """A rule whose answers are not bounded by its positive literals."""


class StratificationError(DatalogError):
    """Recursion through negation or an aggregate."""

    def __init__(self, message: str, cycle: tuple[str, ...] = ()):
        super().__init__(message)
        self.cycle = cycle


@dataclass(frozen=True)
class Var:
    name: str

    @property
    def anonymous(self) -> bool:
        return self.name.startswith("_#")

    def __str__(self) -> str:
        return "_" if self.anonymous else self.name


@dataclass(frozen=True)
class Const:
    value: str | int | float

    def __str__(self) -> str:
        return format_value(self.value)


@dataclass(frozen=True)
class Struct:
    functor: str
    args: tuple

    def __str__(self) -> str:
        return f"{self.functor}({', '.join(map(str, self.args))})"


Term = Var | Const | Struct


@dataclass(frozen=True)
class Atom:
    pred: str
    args: tuple[Term, ...] = ()

    @property
    def comparison(self) -> bool:
        return self.pred in COMPARISONS

    @property
    def variables(self) -> list[Var]:
        """Distinct variables in order of appearance."""
        out: dict[Var, None] = {}

        def walk(t: Term) -> None:
            if isinstance(t, Var):
                out[t] = None
            elif isinstance(t, Struct):
                for a in t.args:
                    walk(a)

        for a in self.args:
            walk(a)
        return list(out)

    def __str__(self) -> str:
        if self.comparison:
            return f"{self.args[0]} {self.pred} {self.args[1]}"
        return f"{self.pred}({', '.join(map(str, self.args))})" if self.args else self.pred


@dataclass(frozen=True)
class Literal:
    atom: Atom
    negated: bool = False

    def __str__(self) -> str:
        return f"not {self.atom}" if self.negated else str(self.atom)


@dataclass(frozen=True)
class Rule:
    """A fact (no body), a rule, or a constraint (no head)."""

    head: Atom | None
    body: tuple[Literal, ...] = ()
    weight: int | float | None = None
    retract: bool = False

    @property
    def constraint(self) -> bool:
        return self.head is None

    @property
    def positive(self) -> list[Literal]:
        return [x for x in self.body if not x.negated and not x.atom.comparison]

    @property
    def negative(self) -> list[Literal]:
        return [x for x in self.body if x.negated]

    @property
    def comparisons(self) -> list[Literal]:
        return [x for x in self.body if x.atom.comparison]

    def __str__(self) -> str:
        head = "" if self.head is None else str(self.head)
        if not self.body:
            return head + ("~" if self.retract else f" @ {self.weight}" if self.weight is not None else "") + "."
        return f"{head} :- ".lstrip() + ", ".join(map(str, self.body)) + "."


@dataclass
class Program:
    """Clauses by role, with arities; made by ``analysis.analyse``."""

    facts: list[Rule] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    constraints: list[Rule] = field(default_factory=list)
    arity: dict[str, int] = field(default_factory=dict)
    components: list[list[str]] = field(default_factory=list)
    strata: dict[str, int] = field(default_factory=dict)

    @property
    def derived(self) -> set[str]:
        return {r.head.pred for r in self.rules}


def aggregate_of(atom: Atom) -> tuple[int, str, Var] | None:
    """(place, function, variable) of the head's aggregate."""
    found = [(k, a) for k, a in enumerate(atom.args) if isinstance(a, Struct)]
    if not found:
        return None
    k, a = found[0]
    if len(found) > 1 or a.functor not in AGGREGATES or len(a.args) != 1 or not isinstance(a.args[0], Var):
        raise SafetyError(f"a head takes one of {', '.join(AGGREGATES)} over one variable, once: {atom}")
    return k, a.functor, a.args[0]


def format_value(v: object) -> str:
    if isinstance(v, str):
        plain = v[:1].islower() and v.isascii() and v.replace("_", "").isalnum() and v != "not"
        return v if plain else f"'{v}'" if '"' in v else f'"{v}"'
    return repr(v)


def format_fact(pred: str, values: tuple) -> str:
    return (f"{pred}({', '.join(map(format_value, values))})" if values else pred) + "."


def sort_key(values: tuple) -> tuple:
    """Numbers before strings, place by place."""
    return tuple((isinstance(v, str), v if isinstance(v, str) else 0, v if not isinstance(v, str) else 0) for v in values)
