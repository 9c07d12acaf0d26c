"""``python -m deducta.cli TOOL ...``: programs and the tools around them.

Exit codes: 0 fine, 1 error, 2 not stratified, 3 a constraint, expectation or example fails.
"""

from __future__ import annotations

import argparse
import sys

from .functions import chase, containment, defeasible, explain, learn, ontology, prolog, stable
from .functions.local import Model
from .plans.analysis import lint
from .plans.ast import DatalogError, StratificationError, format_fact, sort_key
from .plans.parser import parse, parse_goal
from .sources.facts import read_program


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("deducta").getOrCreate()


def _show(pred: str, rows: list[tuple], kind: str) -> None:
    print(f"% {pred}/{len(rows[0]) if rows else 0} ({kind}) — {len(rows)} facts")
    for r in sorted(rows, key=sort_key):
        print(format_fact(pred, r))


def _goal(text: str) -> tuple[str, tuple]:
    a = parse_goal(text)
    return a.pred, tuple(t.value for t in a.args)


def datalog(a: argparse.Namespace) -> int:
    from .api import ENGINES, assume

    clauses = parse(read_program(a.program))
    if a.assume:
        clauses = assume(clauses, a.assume)
    for w in lint(clauses):
        print("warning:", w, file=sys.stderr)
    if a.models:
        true, undefined = stable.well_founded(clauses)
        for m in stable.stable_models(clauses):
            print("model:", " ".join(sorted(format_fact(*f) for f in m)))
        print("true:", " ".join(sorted(format_fact(*f) for f in true)))
        print("undefined:", " ".join(sorted(format_fact(*f) for f in undefined)))
        return 0
    if a.explain:
        model = Model(clauses)
        pred, row = _goal(a.explain)
        if model.holds(pred, row):
            print("\n".join(explain.why(model, pred, row).lines()))
        else:
            for rule, literal, values in explain.why_not(model, pred, row):
                print(f"{rule}  stops at {literal or 'its head'} with {values}")
        return 0
    if a.trace and a.engine == "slg":
        raise DatalogError("slg keeps no trace")
    engine = ENGINES[a.engine](_session(), clauses)
    if a.engine == "slg" or (a.query and a.engine != "slg"):
        if not a.query:
            raise DatalogError(f"{a.engine} needs a query")
        found = engine.query(a.query)
        for label, df in (("", found),) if a.engine != "slg" else (("true ", found[0]), ("undefined ", found[1])):
            for r in sorted(map(tuple, df.collect()), key=sort_key):
                print(label + ", ".join(f"{c} = {v}" for c, v in zip(df.columns, r, strict=True)))
    elif engine.goal_directed:
        raise DatalogError(f"{a.engine} needs a query")
    else:
        for p in sorted(engine.program.arity):
            if p in engine.program.derived or a.all:
                rows = [tuple(r) if engine.program.arity[p] else () for r in engine.relation(p).collect()]
                _show(p, rows, "derived" if p in engine.program.derived else "input")
    if a.trace:
        for preds, turn, n in engine.log:
            print(f"% {', '.join(preds)}: " + (f"round {turn}, {n} grew" if turn else f"in memory, {n} rows"), file=sys.stderr)
    if a.engine == "slg":
        return 0
    bad = [(c, d.collect()) for c, d in engine.violations()] if not engine.goal_directed else []
    for c, rows in bad:
        for r in rows:
            print(f"violated: {c}  {r.asDict()}")
    return 3 if any(rows for _, rows in bad) else 0


def run_chase(a: argparse.Namespace) -> int:
    clauses = parse(read_program(a.program))
    if cycle := chase.dangerous_cycle([c for c in clauses if c.body]):
        print("warning: the chase may not end:", cycle, file=sys.stderr)
    done = chase.Chase(clauses, a.variant, a.max_nulls).run()
    for p in sorted(done.stores):
        for r in done.certain(p) if a.certain else done.rows(p):
            print(f"{p}({', '.join(map(str, r))}).")
    return 0


def run_contains(a: argparse.Namespace) -> int:
    rules = parse(read_program(a.program))
    for r in rules:
        print("core:", containment.minimise(r))
    for x in rules:
        for y in rules:
            if x is not y and x.head.pred == y.head.pred and containment.contains(x, y) is not None:
                print(f"{y}  is contained in  {x}")
    return 0


def run_defeasible(a: argparse.Namespace) -> int:
    t = defeasible.tags(defeasible.Theory.parse(read_program(a.program)), a.propagate)
    for name, found in (("+D", t.definite), ("-D", t.not_definite), ("+d", t.provable), ("-d", t.refuted), ("undecided", t.undecided)):
        print(name, " ".join(sorted(format_fact(*f)[:-1] for f in found)))
    return 0


def run_diagnose(a: argparse.Namespace) -> int:
    hold, deny = explain.read_expectations(read_program(a.expectations))
    found = explain.diagnose(Model(read_program(a.program)), hold, deny)
    for f in found:
        print(f.kind, f.what, f.rule or "")
    return 3 if found else 0


def run_mutation(a: argparse.Namespace) -> int:
    hold, deny = explain.read_expectations(read_program(a.expectations))
    caught, alive = explain.mutation_score(parse(read_program(a.program)), hold, deny)
    print(f"{len(caught)} of {len(caught) + len(alive)} mutants caught")
    for x in alive:
        print("alive:", x)
    return 3 if alive else 0


def run_learn(a: argparse.Namespace) -> int:
    model = Model(read_program(a.program))
    target, good, bad = learn.read_examples(read_program(a.examples), model)
    if a.tool == "foil":
        rules = learn.foil(model, target, good, bad)
    else:
        preds = {p: n for p, n in model.program.arity.items()} | {target: len(good[0])}
        pool = parse(read_program(a.candidates)) if a.candidates else learn.candidates(preds, target, len(good[0]))
        rules = learn.synthesise(model, pool, target, good, bad)
    print("\n".join(map(str, rules)))
    return 0


def run_prolog(a: argparse.Namespace) -> int:
    found, cut = prolog.Prolog(read_program(a.program)).query(a.query, a.depth, a.max_solutions)
    for x in found:
        print(", ".join(f"{k} = {v}" for k, v in x.items()) or "true")
    if cut:
        print("% incomplete: a bound cut the search")
    return 0


def run_ontology(a: argparse.Namespace) -> int:
    o = ontology.Ontology(read_program(a.program))
    if a.emit:
        print(o.emit())
        return 0
    for c, above in sorted(o.direct_subsumers().items()):
        print(f"{c}: {', '.join(above)}")
    print("unsatisfiable:", ", ".join(o.unsatisfiable()))
    return 0


def run_semiring(a: argparse.Namespace) -> int:
    from .operators.semiring import SemiringEngine

    values = SemiringEngine(_session(), parse(read_program(a.program)), a.semiring, max_rounds=a.max_rounds).run()
    atom = parse_goal(a.query)
    from .functions.local import extend

    for r in values[atom.pred].collect():
        if extend(atom, tuple(r)[:-1], {}) is not None:
            print(format_fact(atom.pred, tuple(r)[:-1])[:-1], "@", r["_k"])
    return 0


def run_update(a: argparse.Namespace) -> int:
    from .operators.incremental import Materialized

    m = Materialized(_session(), read_program(a.program))
    for counts in m.apply(read_program(a.script), a.how):
        print(counts)
    for p in sorted(m.program.derived):
        _show(p, [tuple(r) for r in m.relations[p].collect()], "derived")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="deducta", description=__doc__)
    tools = parser.add_subparsers(dest="tool", required=True)

    def tool(name: str, run, *options: tuple) -> None:
        p = tools.add_parser(name)
        p.add_argument("program")
        for flags, kw in options:
            p.add_argument(*flags.split(), **kw)
        p.set_defaults(run=run)

    query = ("-q --query", {})
    tool("datalog", datalog, query, ("-a --all", {"action": "store_true"}), ("-e --explain", {}), ("-M --models", {"action": "store_true"}), ("--assume", {}), ("-t --trace", {"action": "store_true"}), ("--engine", {"default": "seminaive", "choices": ["seminaive", "naive", "magic", "tabling", "slg"]}))
    tool("chase", run_chase, ("--variant", {"default": "restricted"}), ("--max-nulls", {"type": int, "default": 1000}), ("--certain", {"action": "store_true"}))
    tool("containment", run_contains)
    tool("defeasible", run_defeasible, ("--propagate", {"action": "store_true"}))
    tool("diagnose", run_diagnose, ("expectations", {}))
    tool("mutation", run_mutation, ("expectations", {}))
    tool("foil", run_learn, ("examples", {}))
    tool("synthesis", run_learn, ("examples", {}), ("--candidates", {}))
    tool("prolog", run_prolog, ("-q --query", {"required": True}), ("--depth", {"type": int, "default": 100}), ("--max-solutions", {"type": int}))
    tool("subsumption", run_ontology, ("--emit", {"action": "store_true"}))
    tool("semiring", run_semiring, ("-q --query", {"required": True}), ("--semiring", {"default": "minplus"}), ("--max-rounds", {"type": int, "default": 200}))
    tool("incremental", run_update, ("script", {}), ("--how", {"default": "dred"}))
    a = parser.parse_args(argv)
    try:
        return a.run(a)
    except StratificationError as e:
        print("error:", e, file=sys.stderr)
        return 2
    except DatalogError as e:
        print("error:", e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
