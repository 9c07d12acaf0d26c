"""DataFrame evaluation against the in-memory model, SQL twins, and updates against recomputation."""

import random

import duckdb
import pytest

from deducta import catalog
from deducta.api import ENGINES, Engine, MagicEngine, SlgEngine, TabledEngine, assume, run_program
from deducta.functions import stable
from deducta.functions.local import Model
from deducta.operators.incremental import Materialized
from deducta.operators.lattice import best, lattices
from deducta.operators.semiring import SEMIRINGS, SemiringEngine
from deducta.plans.ast import DatalogError
from deducta.plans.parser import parse, parse_goal
from deducta.sources.facts import chain, clique, grid, python_facts, relation, tree

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


FAST = [n for n in catalog.ENTRIES if n.split("_")[0] in ("FIL", "PRJ", "QRY", "JOIN", "SET", "AGG", "NEG", "ICN", "SRC", "CHS", "ONT", "DEF", "STB", "PRO", "ILP", "CON", "SLG") and catalog.ENTRIES[n][1]] + ["REC_1_reach_linear", "REC_4_reach_nonlinear", "REC_5_odd_even", "REC_8_for_all", "WFS_3_win_true", "SEM_2_cheapest", "INC_2_delete_dred"]


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, sql, name):
    query, twin = catalog.ENTRIES[name]
    df = query(spark, DATA)
    found = sql.execute(twin)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.select(*names)) == sorted(found.fetchall())


PROGRAM = """
parent(a, b). parent(b, c). parent(c, d). parent(a, e).
anc(X, Y) :- parent(X, Y). anc(X, Z) :- parent(X, Y), anc(Y, Z). anc(z, z).
leaf(X) :- parent(_, X), not inner(X). inner(X) :- parent(X, _).
n(X, count(Y)) :- anc(X, Y). all(count(Y)) :- anc(_, Y). none(count(X)) :- zip(X).
odd(X, Y) :- parent(X, Y). odd(X, Z) :- even(X, Y), parent(Y, Z). even(X, Z) :- odd(X, Y), parent(Y, Z).
flag :- anc(a, d). no :- anc(d, a). ok(X) :- parent(X, _), flag, not no.
:- n(X, N), N > 3.
"""


@pytest.mark.parametrize("engine", ["seminaive", "naive", "magic", "tabling", "distributed"])
def test_engines_agree(spark, engine):
    e, m = (Engine(spark, PROGRAM, small_rows=0) if engine == "distributed" else run_program(spark, PROGRAM, engine=engine)), Model(PROGRAM)
    for goal in ("anc(b, X)", "leaf(X)", "n(X, N)", "all(N)", "none(N)", "even(X, Y)", "ok(X)", "parent(a, X)"):
        assert rows(e.query(goal)) == sorted(tuple(r.values()) for r in m.query(goal)), goal
    assert e.query("flag").count() == 1 and e.query("no").count() == 0 and e.query("anc(a, d)").count() == 1
    if not e.goal_directed:
        ((_, bad),) = e.violations()
        assert rows(bad) == [("a", 4)]


def random_program(r):
    """Stratified: s over p, q, r; t over s with negation, a comparison and an aggregate."""
    c = "abcd"
    out = [f"{p}({r.choice(c)}, {r.choice(c)})." for p in "pq" for _ in range(r.randint(1, 5))] + [f"r({r.choice(c)})." for _ in range(r.randint(1, 3))]
    v = ["X", "Y", "Z"]
    for head in ("s(X, Y)", "s(X, Y)", "t(X)", "t(X)"):
        body = ["p(X, Y)"] + [f"{r.choice('pq' if head[0] == 's' else 'pqs')}({r.choice(v)}, {r.choice(v)})" for _ in range(r.randint(0, 2))]
        if head[0] == "s" and r.random() < 0.6:
            body.append(f"s({r.choice(v[:2])}, {r.choice(v[:2])})")
        if r.random() < 0.4:
            body.append("X != Y")
        if r.random() < 0.4:
            body.append("not r(X)" if head[0] == "s" else "not s(Y, X)")
        out.append(f"{head} :- {', '.join(body)}.")
    return "\n".join([*out, "a(X, count(Y)) :- s(X, Y)."])


def test_random_programs(spark):
    r = random.Random(12)
    for _ in range(4):
        text = random_program(r)
        m = Model(text)
        for e in (Engine(spark, text), Engine(spark, text, small_rows=0)):
            for p in "sta":
                assert rows(e.relation(p)) == sorted(m.rows(p)), text
        (x,) = rows(e.query("p(X, _)"))[0]
        magic = ENGINES["magic"](spark, text)
        goal = f"s({x}, Y)"
        assert rows(magic.query(goal)) == sorted(tuple(a.values()) for a in m.query(goal)), text


def test_nonlinear_and_seeded_recursion(spark):
    e = Engine(spark, "p(X, Y) :- e(X, Y). p(X, Z) :- p(X, Y), p(Y, Z).", {"e": chain(spark, 12)})
    assert e.relation("p").count() == 66
    assert Engine(spark, "p(a, b). p(X, Z) :- p(X, Y), e(Y, Z). e(b, c). e(c, a).").relation("p").count() == 3


def test_what_grows_goes_over_to_the_distributed_loop(spark, monkeypatch):
    from deducta.operators import fixpoint

    monkeypatch.setattr(fixpoint, "SMALL_DERIVED", 20)
    e = Engine(spark, "p(X, Y) :- e(X, Y). p(X, Z) :- p(X, Y), p(Y, Z).", {"e": chain(spark, 12)})
    assert e.relation("p").count() == 66 and len(e.log) > 1


def test_doubling_keeps_the_answers(spark):
    for text in ("p(X, Y) :- e(X, Y). p(X, Z) :- e(X, Y), p(Y, Z).", "p(X, Y) :- e(X, Y). p(X, Z) :- p(X, Y), e(Y, Z)."):
        a, b = (Engine(spark, text, {"e": grid(spark, 4)}, doubling=d, small_rows=0) for d in (True, False))
        assert rows(a.relation("p")) == rows(b.relation("p"))
        assert len(a.log) < len(b.log)


def test_generators(spark):
    assert [d.count() for d in (chain(spark, 5), tree(spark, 3), clique(spark, 4), grid(spark, 3))] == [4, 14, 12, 12]


def test_facts_and_values(spark):
    e = Engine(spark, "q(X) :- p(X, _).", {"p": [("a", 1), ("b", 2), ("a", 1)], "z": ["u", "v"]})
    assert rows(e.query("q(X)")) == [("a",), ("b",)] and rows(e.query("z(X)")) == [("u",), ("v",)]
    for bad in ({"P": [1]}, {"p": [True]}, {"p": [None]}, {"p": ["a​b"]}, {"p": ["'\""]}, {"p": [float("inf")]}):
        with pytest.raises(DatalogError):
            python_facts(bad)
    with pytest.raises(DatalogError):
        Engine(spark, "p(1). p(a). q(X) :- p(X).").relation("q")
    with pytest.raises(DatalogError):
        e.query("missing(X)")
    with pytest.raises(DatalogError):
        relation(spark.sql("SELECT array(1) AS x"))


def test_kinds_do_not_mix(spark):
    e = Engine(spark, "q(X) :- p(X, Y), r(Y). u(X) :- p(X, Y), X != Y. p(1, a). r(1). v(X) :- p(X, b).")
    assert [e.relation(x).count() for x in "quv"] == [0, 1, 0]
    with pytest.raises(DatalogError):
        Engine(spark, "q(X) :- p(X, Y), X < Y. p(1, a).").relation("q")


def test_assumptions():
    clauses = assume(parse("p(a). p(b)."), "p(c). p(a)~.")
    assert [str(c) for c in clauses] == ["p(b).", "p(c)."]
    for bad in ("p(z)~.", "q(X) :- p(X)."):
        with pytest.raises(DatalogError):
            assume(parse("p(a)."), bad)


def test_tables_are_kept_and_dropped(spark):
    e = TabledEngine(spark, "edge(a, b). edge(b, c). path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z). other(x).")
    assert e.query("path(X, Y)").count() == 3 and e.query("path(a, Y)").count() == 2 and len(e.tables) == 1
    assert e.apply("edge(c, d).") == 1 and e.query("path(a, Y)").count() == 3
    assert e.apply("other(y).") == 0


# ------------------------------------------------------------------ annotated, lattice, well-founded

WALKS = "arc(1, 2) @ 3. arc(1, 3) @ 1. arc(2, 4) @ 2. arc(3, 4) @ 5. arc(4, 5) @ 1. walk(X, Y) :- arc(X, Y). walk(X, Z) :- walk(X, Y), arc(Y, Z)."


def test_semirings(spark):
    value = lambda s, goal: {tuple(r)[:-1]: r["_k"] for r in SemiringEngine(spark, parse(WALKS), s).run()["walk"].collect()}[goal]
    assert value("minplus", (1, 5)) == 6 and value("count", (1, 5)) == 2 and value("bool", (1, 5))
    assert value("why", (1, 4)) == [["arc(1, 2)", "arc(2, 4)"], ["arc(1, 3)", "arc(3, 4)"]]
    sent = "hop(x, y) @ 0.9. hop(y, z) @ 0.6. hop(x, z) @ 0.5. got(X, Y) :- hop(X, Y). got(X, Z) :- hop(X, Y), got(Y, Z)."
    assert abs(SemiringEngine(spark, parse(sent), "viterbi").run()["got"].where("c0 = 'x' AND c1 = 'z'").first()["_k"] - 0.54) < 1e-12
    with pytest.raises(DatalogError):
        SemiringEngine(spark, parse(WALKS + " arc(5, 1)."), "count").run()


def test_cheapest_is_the_cheapest_reason(spark):
    weights = {"arc(1, 2)": 3, "arc(1, 3)": 1, "arc(2, 4)": 2, "arc(3, 4)": 5, "arc(4, 5)": 1}
    why = SemiringEngine(spark, parse(WALKS), "why").run()["walk"].collect()
    cost = {tuple(r)[:-1]: r["_k"] for r in SemiringEngine(spark, parse(WALKS), "minplus").run()["walk"].collect()}
    assert {tuple(r)[:-1]: min(sum(weights[t] for t in s) for s in r["_k"]) for r in why} == cost


def test_annotated_loops_agree_with_rounds_over_all_values(spark):
    r = random.Random(21)
    arcs = sorted({(r.randint(0, 7), r.randint(0, 7)) for _ in range(14)})
    text = " ".join(f"arc({a}, {b}) @ 0.{1 + (3 * a + b) % 9}." for a, b in arcs)
    twice = " near(X, Y) :- arc(X, Y). near(X, Z) :- near(X, Y), near(Y, Z). odd(X, Y) :- near(X, Y), X > 3. odd(X, Z) :- even(X, Y), arc(Y, Z). even(X, Z) :- odd(X, Y), arc(Y, Z)."
    shown = lambda d: sorted((tuple(x)[:-1], x["_k"] if not isinstance(x["_k"], float) else round(x["_k"], 9)) for x in d.collect())
    for kind in ("bool", "minplus", "viterbi"):
        rounds = SEMIRINGS[kind]()
        rounds.idempotent = False
        want, got = (SemiringEngine(spark, parse(text + twice), s).run() for s in (rounds, kind))
        for p in ("near", "odd", "even"):
            assert shown(got[p]) == shown(want[p]) != []


def test_annotated_loops_that_diverge_and_start_from_tables(spark):
    with pytest.raises(DatalogError):
        SemiringEngine(spark, parse("arc(1, 2) @ -3. arc(2, 1) @ 1. walk(X, Y) :- arc(X, Y). walk(X, Z) :- walk(X, Y), arc(Y, Z)."), "minplus").run()
    known = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0)], "x long, y long, _w double")
    found = SemiringEngine(spark, parse("arc(3, 4) @ 2. walk(X, Z) :- walk(X, Y), arc(Y, Z). walk(X, Z) :- walk(X, Y), walk(Y, Z)."), "minplus", {"walk": known}).run()["walk"]
    assert {tuple(r)[:-1]: r["_k"] for r in found.collect()} == {(1, 2): 5, (2, 3): 1, (1, 3): 6, (2, 4): 3, (1, 4): 8}


def test_recursive_extremes(spark):
    r = random.Random(12)
    links = sorted({(r.randint(0, 14), r.randint(0, 14)) for _ in range(22)})
    reach = {x: {y for a, y in links if a == x} for x, _ in links}
    for _ in range(15):
        reach = {x: ys | {z for y in ys for z in reach.get(y, ())} for x, ys in reach.items()}
    text = " ".join(f"link({a}, {b})." for a, b in links)
    for f, g in ((min, "min"), (max, "max")):
        rules = f"end(X, {g}(Y)) :- link(X, Y). end(X, {g}(Z)) :- link(X, Y), end(Y, Z)."
        assert rows(best(spark, parse(text + rules))["end"]) == sorted((x, f(ys)) for x, ys in reach.items())
    heat = "source(7, 30). source(8, 12). wire(7, 9, 20). wire(8, 9, 5). wire(9, 10, 25). wire(10, 11, 31). "
    carried = "hot(X, max(V)) :- source(X, V). hot(Y, max(V)) :- hot(X, V), wire(X, Y, T), V >= T."
    assert rows(best(spark, parse(heat + carried))["hot"]) == [(7, 30), (8, 12), (9, 30), (10, 30)]
    both = carried + " hot(Y, max(V)) :- hot(X, V), wire(X, Y, T), V < T."
    assert rows(best(spark, parse(heat + both))["hot"]) == [(7, 30), (8, 12), (9, 30), (10, 30), (11, 30)]
    for bad in ("d(Y, min(C)) :- e(Y, C). d(Y, min(C)) :- d(X, B), e(Y, C), B > C.", "d(Y, min(C)) :- e(Y, C). d(Y, max(C)) :- d(X, C), f(X, Y).", "d(Y, min(C)) :- e(Y, C). d(C, min(C)) :- d(X, C), f(X, X)."):
        with pytest.raises(DatalogError):
            lattices(parse(bad))


def test_constraints_by_demand(spark):
    text = "e(1, 2). e(2, 3). e(3, 1). e(4, 5). p(X, Y) :- e(X, Y). p(X, Z) :- e(X, Y), p(Y, Z). :- p(X, X), X > 1. :- e(X, 5), not p(5, X). :- p(1, 4)."
    want = [rows(x) for _, x in Engine(spark, text).violations()]
    assert [rows(x) for _, x in MagicEngine(spark, text).violations()] == want == [[(2,), (3,)], [(4,)], []]
    assert [rows(x) for _, x in TabledEngine(spark, text).violations()] == want


def test_nulls_are_refused(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "x long, y string")
    with pytest.raises(Exception, match="null"):
        Engine(spark, "q(X) :- p(X, _).", {"p": df}).relation("q").collect()
    assert rows(Engine(spark, "q(X) :- p(X, _).", {"p": df.dropna()}).relation("q")) == [(1,)]


def test_well_founded_matches_the_ground_program(spark):
    r = random.Random(9)
    for _ in range(3):
        text = "".join(f"move({r.choice('abcdef')}, {r.choice('abcdef')}). " for _ in range(8)) + "win(X) :- move(X, Y), not win(Y). safe(X) :- move(X, _), not win(X)."
        true, undefined = SlgEngine(spark, text).query("win(X)")
        t, u = stable.well_founded(parse(text))
        assert rows(true) == sorted(x for p, x in t if p == "win") and rows(undefined) == sorted(x for p, x in u if p == "win")


def test_slg_constraints(spark):
    e = SlgEngine(spark, "move(a, b). move(b, a). move(b, c). move(c, d). win(X) :- move(X, Y), not win(Y). :- win(X).")
    ((_, sure, may),) = e.violations()
    assert rows(sure) == [("c",)] and rows(may) == [("a",), ("b",)]


# ------------------------------------------------------------------ updates

PATH = "path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z)."


@pytest.mark.parametrize("how", ["dred", "bf"])
def test_updates_are_recomputation(spark, how):
    r = random.Random(15)
    edges = {(r.choice("abcdef"), r.choice("abcdef")) for _ in range(9)}
    text = lambda e: " ".join(f"edge({a}, {b})." for a, b in sorted(e))
    m = Materialized(spark, text(edges) + PATH)
    for _ in range(3):
        gone = r.choice(sorted(edges))
        new = (r.choice("abcdef"), r.choice("abcdef"))
        m.apply(f"edge({gone[0]}, {gone[1]})~. edge({new[0]}, {new[1]}).", how)
        edges = edges - {gone} | {new}
        assert rows(m.relations["path"]) == Model(text(edges) + PATH).rows("path")


def test_update_counts_and_refusals(spark):
    m = Materialized(spark, "edge(a, b). edge(b, c). path(x, y). " + PATH)
    assert m.insert("edge(c, d).") == {"inserted": 1, "derived": 3}
    assert m.delete("edge(a, b).")["net_removed"] == 4
    with pytest.raises(DatalogError):
        m.delete("path(b, c).")
    for bad in ("p(X) :- q(X), not r(X).", "p(count(X)) :- q(X).", "p(a) @ 3."):
        with pytest.raises(DatalogError):
            Materialized(spark, bad)


def test_stream_maintenance(spark, tmp_path):
    from deducta.streaming.maintain import maintain

    source = str(tmp_path / "edges")
    spark.createDataFrame([("a", "b"), ("b", "c")], "x string, y string").write.parquet(source)
    m = Materialized(spark, "edge(c, d). " + PATH)
    stream = spark.readStream.schema("x string, y string").parquet(source)
    maintain(stream, "edge", m, str(tmp_path / "state")).awaitTermination(60)
    assert m.relations["path"].count() == 6


def test_command_line(spark, tmp_path, capsys):
    from deducta.cli import main

    f = tmp_path / "p.dl"
    f.write_text("e(a, b). e(b, c). p(X, Y) :- e(X, Y). p(X, Z) :- e(X, Y), p(Y, Z). :- p(X, X).")
    assert main(["datalog", str(f), "-q", "p(a, X)"]) == 0 and "X = c" in capsys.readouterr().out
    assert main(["datalog", str(f), "-e", "p(a, c)"]) == 0 and "p(b, c)" in capsys.readouterr().out
    assert main(["datalog", str(f), "-t"]) == 0 and "p: in memory, 3 rows" in capsys.readouterr().err
    assert main(["datalog", str(f), "-t", "--engine", "naive"]) == 0 and "p: round 1, 1 grew" in capsys.readouterr().err
    assert main(["datalog", str(f), "-t", "--engine", "slg", "-q", "p(a, X)"]) == 1
    f.write_text("e(a, a). :- e(X, X).")
    assert main(["datalog", str(f)]) == 3
    f.write_text("win(X) :- m(X, Y), not win(Y). m(a, b).")
    assert main(["datalog", str(f)]) == 2 and main(["datalog", str(f), "--engine", "slg", "-q", "win(X)"]) == 0
    assert main(["datalog", str(tmp_path / "none.dl")]) == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert parse_goal("p(X)").pred == "p"


def test_defeasible_reads_every_supplier(spark, tmp_path):
    n = 10_500
    spark.range(n).selectExpr("id AS s_suppkey", "id % 3 - 1.0D AS s_acctbal", "id % 11 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(r.s for r in catalog.queries()["DEF_2_defeasible"](spark, str(tmp_path)).collect())
    assert got == sorted(f"s{k}" for k in range(n) if k % 3 or k % 11 == 7)
