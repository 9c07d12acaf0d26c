"""Registered queries over the star-schema tables, each by rules, with SQL twins.

Names carry the operator ids of the survey.  Relations are prepared from Parquet with the columns a
query needs; answers are renamed to lower case.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import ENGINES, Engine, SlgEngine, TabledEngine
from .functions.chase import Chase, Null
from .functions.containment import minimise
from .functions.defeasible import Theory, tags
from .functions.explain import mutation_score, read_expectations, why
from .functions.learn import candidates, foil, read_examples, synthesise
from .functions.local import Model
from .functions.ontology import Ontology
from .functions.prolog import Prolog, number
from .functions.stable import stable_models
from .operators.incremental import Materialized
from .operators.lattice import best
from .operators.semiring import SemiringEngine
from .operators.wellfounded import well_founded
from .plans.ast import format_fact
from .plans.parser import parse
from .sources.facts import WithoutNulls, chain, relation

Query = Callable[[SparkSession, str], DataFrame]

# ---------------------------------------------------------------- external relations


def _table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table, as rows without nulls, which are no facts."""
    rows = spark.read.parquet(f"{d}/{name}.parquet").selectExpr(*columns)
    return rows.where(" AND ".join(f"{c} IS NOT NULL" for c in rows.columns))


def sup(spark: SparkSession, d: str) -> DataFrame:
    """Supplier s before d: consecutive lines of one order, the first with a quantity of 50 or more."""
    a = _table(spark, d, "lineitem", "l_orderkey AS o", "l_linenumber + 1 AS n", "l_suppkey AS s", "l_quantity AS q").where("q >= 50").drop("q")
    b = _table(spark, d, "lineitem", "l_orderkey AS o", "l_linenumber AS n", "l_suppkey AS t")
    return a.join(b, ["o", "n"]).where("s < t").select("s", "t").distinct()


def sup_cost(spark: SparkSession, d: str) -> DataFrame:
    """The same edges with the least price of such a first line in cents."""
    a = _table(spark, d, "lineitem", "l_orderkey AS o", "l_linenumber + 1 AS n", "l_suppkey AS s", "l_quantity AS q", "CAST(round(l_extendedprice * 100) AS BIGINT) AS c").where("q >= 50").drop("q")
    b = _table(spark, d, "lineitem", "l_orderkey AS o", "l_linenumber AS n", "l_suppkey AS t")
    return a.join(b, ["o", "n"]).where("s < t").groupBy("s", "t").agg(F.min("c").alias("c")).where("c IS NOT NULL")


def turn(spark: SparkSession, d: str) -> DataFrame:
    a = _table(spark, d, "conversations", "conv_id AS c", "turn AS a")
    return a.join(a.selectExpr("c", "a - 1 AS a", "a AS b").distinct(), ["c", "a"]).select("c", "a", "b").distinct()


def step(spark: SparkSession, d: str) -> DataFrame:
    """Event types that follow one another for some user."""
    e = _table(spark, d, "events", "user_id AS u", "ts", "event_id", "event_type AS a")
    return e.selectExpr("a", "lead(a) OVER (PARTITION BY u ORDER BY ts, event_id) AS b").where("b IS NOT NULL").distinct()


def contains(spark: SparkSession, d: str) -> DataFrame:
    r = _table(spark, d, "nation", "concat('r', n_regionkey) AS x", "concat('n', n_nationkey) AS y")
    return r.union(_table(spark, d, "customer", "concat('n', c_nationkey) AS x", "concat('c', c_custkey) AS y"))


_TABLES = {
    "supplier": ("supplier", "s_suppkey"),
    "snation": ("supplier", "s_suppkey", "s_nationkey"),
    "balance": ("supplier", "s_suppkey", "s_nationkey", "CAST(round(s_acctbal * 100) AS BIGINT) AS b"),
    "nation": ("nation", "n_nationkey", "n_name", "n_regionkey"),
    "region": ("region", "r_regionkey", "r_name"),
    "customer": ("customer", "c_custkey", "c_nationkey", "c_mktsegment"),
    "orders": ("orders", "o_orderkey", "o_custkey", "o_orderstatus", "CAST(round(o_totalprice * 100) AS BIGINT) AS p", "o_orderpriority"),
    "line": ("lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag"),
    "part": ("part", "p_partkey", "p_brand", "p_size"),
    "event": ("events", "user_id", "event_id", "unix_micros(CAST(ts AS TIMESTAMP)) AS t"),
}
_MADE = {"sup": sup, "cost": sup_cost, "turn": turn, "step": step, "contains": contains}


def _facts(spark: SparkSession, d: str, names: str) -> dict[str, WithoutNulls]:
    """All are read by ``_table``, which leaves nulls out."""
    out = {}
    for n in names.split():
        out[n] = WithoutNulls(_MADE[n](spark, d) if n in _MADE else _table(spark, d, *_TABLES[n]))
    return out


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))


def rules(text: str, goal: str, names: str, engine: str = "seminaive", **kw) -> Query:
    """A query that evaluates the rules over these relations and asks the goal."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _lower(ENGINES[engine](spark, text, _facts(spark, d, names), **kw).query(goal))

    return run


# ---------------------------------------------------------------- programs and twins

SUP = "sup AS (SELECT DISTINCT a.l_suppkey AS s, b.l_suppkey AS d FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 50 AND a.l_suppkey < b.l_suppkey)"
COST = "cost AS (SELECT a.l_suppkey AS s, b.l_suppkey AS d, min(CAST(round(a.l_extendedprice * 100) AS BIGINT)) AS c FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 50 AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2)"
TURN = "turn AS (SELECT DISTINCT a.conv_id AS c, a.turn AS a, b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
STEP = "step AS (SELECT DISTINCT a, b FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL)"
CONTAINS = "contains AS (SELECT 'r' || n_regionkey AS x, 'n' || n_nationkey AS y FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"
PATHS = f"{SUP}, p AS (SELECT s, d FROM sup UNION SELECT sup.s, p.d FROM sup JOIN p ON sup.d = p.s)"
FROM_7 = f"{SUP}, r AS (SELECT d FROM sup WHERE s = 7 UNION SELECT sup.d FROM sup JOIN r ON sup.s = r.d)"

#: A node is won if it has a move to one that is not alive, and alive if it has a move to one that is not won, as far as is known.
WINS = (
    "WITH RECURSIVE hop AS (SELECT DISTINCT a.l_suppkey AS s, b.l_suppkey AS d FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"
    " WHERE a.l_quantity >= 50 AND a.l_suppkey <> b.l_suppkey AND a.l_suppkey % 10 <> 9),"
    " w AS (SELECT 0 AS k, CAST([] AS BIGINT[]) AS won, (SELECT list(x) FROM (SELECT s AS x FROM hop UNION SELECT d FROM hop)) AS alive"
    " UNION ALL SELECT w.k + 1, coalesce((SELECT list(DISTINCT hop.s) FROM hop WHERE NOT list_contains(w.alive, hop.d)), CAST([] AS BIGINT[])),"
    " coalesce((SELECT list(DISTINCT hop.s) FROM hop WHERE NOT list_contains(w.won, hop.d)), CAST([] AS BIGINT[])) FROM w WHERE w.k < 60)"
)

LINEAR = "p(S, D) :- sup(S, D). p(S, D) :- sup(S, M), p(M, D)."
LEFT = "p(S, D) :- sup(S, D). p(S, D) :- p(S, M), sup(M, D)."
ODD_EVEN = "odd(X, Y) :- sup(X, Y). odd(X, Z) :- even(X, Y), sup(Y, Z). even(X, Z) :- odd(X, Y), sup(Y, Z)."
SAME = "sg(X, X) :- sup(X, _). sg(X, X) :- sup(_, X). sg(X, Y) :- sup(P, X), sg(P, Q), sup(Q, Y)."
TWICE = "p(S, D) :- sup(S, D). p(S, D) :- p(S, M), p(M, D)."
_PATHS_SQL = f"WITH RECURSIVE {PATHS} SELECT s, d FROM p"
_FROM_7_SQL = f"WITH RECURSIVE {FROM_7} SELECT d FROM r"


def _semiring(kind: str, text: str, pred: str, weight: str | None, final: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = sup_cost(spark, d)
        edges = c.select("s", "t") if weight is None else c.selectExpr("s", "t", f"{weight} AS _w")
        values = SemiringEngine(spark, parse(text), kind, {"sup": edges}).run()[pred]
        return final(values.toDF("s", "d", "k"))

    return run


def _recursive_max(spark: SparkSession, d: str) -> DataFrame:
    """AGG_9: the largest supplier that each reaches; a better value replaces the one kept."""
    text = "top(S, max(D)) :- sup(S, D). top(S, max(E)) :- sup(S, D), top(D, E)."
    return best(spark, parse(text), {"sup": relation(sup(spark, d))})["top"].toDF("s", "d")


def _violations(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark, ":- sup(X, Y), sup(Y, Z), X > 50, Z > 90.", {"sup": sup(spark, d)})
    return _lower(e.violations()[0][1])


def _insert(spark: SparkSession, d: str) -> DataFrame:
    edges = sup(spark, d)
    m = Materialized(spark, LEFT, {"sup": edges.where("s % 10 != 3")})
    m.insert({"sup": edges.where("s % 10 = 3")})
    return m.relations["p"].toDF("s", "d")


def _delete(how: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        edges = sup(spark, d)
        m = Materialized(spark, LEFT, {"sup": edges})
        m.delete({"sup": edges.where("s % 25 = 7")}, how)
        return m.relations["p"].toDF("s", "d")

    return run


def hop(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of consecutive lines of one order, in both directions, so that there are cycles; every tenth supplier is an end."""
    a = _table(spark, d, "lineitem", "l_orderkey AS o", "l_linenumber + 1 AS n", "l_suppkey AS s", "l_quantity AS q").where("q >= 50 AND s % 10 != 9").drop("q")
    b = _table(spark, d, "lineitem", "l_orderkey AS o", "l_linenumber AS n", "l_suppkey AS t")
    return a.join(b, ["o", "n"]).where("s != t").select("s", "t").distinct()


def _win(which: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = well_founded(spark, parse("win(X) :- hop(X, Y), not win(Y)."), {"hop": hop(spark, d)})[which]
        return found["win"].toDF("x")

    return run


def _assumed(spark: SparkSession, d: str) -> DataFrame:
    """SRC-5: edges from 7 taken away and one to 7 added before evaluation."""
    from .api import assume

    clauses = assume(parse(LINEAR + " extra(0, 7). extra(1, 7). sup2(S, D) :- sup(S, D), S != 7. sup2(S, D) :- extra(S, D)."), "extra(1, 7)~.")
    text = [c for c in clauses if not (c.head and c.head.pred == "p")] + parse("p(S, D) :- sup2(S, D). p(S, D) :- sup2(S, M), p(M, D).")
    return _lower(Engine(spark, text, {"sup": sup(spark, d)}).query("p(S, D)"))


def _tabled(spark: SparkSession, d: str) -> DataFrame:
    """TAB-2: a general table serves the special call."""
    e = TabledEngine(spark, LINEAR, {"sup": sup(spark, d)})
    e.query("p(S, D)")
    return _lower(e.query("p(7, D)"))


def _closed_world(spark: SparkSession, d: str) -> DataFrame:
    """SRC-7: the examples reader closes the world: nations of one region are examples, all other pairs are not."""
    nations = _table(spark, d, "nation", "concat('n', n_nationkey) AS x", "n_regionkey AS r")
    pairs = nations.join(nations.withColumnRenamed("x", "y"), "r").select("x", "y")
    model = Model(_small_facts(nations.select("x"), "nation"))
    _, _, absent = read_examples(_small_facts(pairs, "near"), model)
    return _frame(spark, absent, "x string, y string")


ENTRIES: dict[str, tuple[Query, str | None]] = {
    # recursion
    "REC_1_reach_linear": (rules(LINEAR, "p(S, D)", "sup"), _PATHS_SQL),
    "REC_1_reach_linear_unrewritten": (rules(LINEAR, "p(S, D)", "sup", doubling=False), _PATHS_SQL),
    "REC_2_reach_naive": (rules(LINEAR, "p(S, D)", "sup", "naive"), _PATHS_SQL),
    "REC_3_reach_left": (rules(LEFT, "p(S, D)", "sup"), _PATHS_SQL),
    "REC_4_reach_nonlinear": (rules(TWICE, "p(S, D)", "sup"), _PATHS_SQL),
    "REC_1_thread_closure": (rules("t(C, A, B) :- turn(C, A, B). t(C, A, B) :- turn(C, A, M), t(C, M, B).", "t(C, A, B)", "turn"), f"WITH RECURSIVE {TURN}, t AS (SELECT c, a, b FROM turn UNION SELECT turn.c, turn.a, t.b FROM turn JOIN t ON turn.c = t.c AND turn.b = t.a) SELECT c, a, b FROM t"),
    "REC_1_containment": (rules("in(X, Y) :- contains(X, Y). in(X, Z) :- contains(X, Y), in(Y, Z).", "in(X, Y)", "contains"), f"WITH RECURSIVE {CONTAINS}, i AS (SELECT x, y FROM contains UNION SELECT contains.x, i.y FROM contains JOIN i ON contains.y = i.x) SELECT x, y FROM i"),
    "REC_5_odd_even": (rules(ODD_EVEN, "even(X, Y)", "sup"), f"WITH RECURSIVE {SUP}, q AS (SELECT s AS x, d AS y, 1 AS k FROM sup UNION SELECT q.x, sup.d, 1 - q.k FROM q JOIN sup ON q.y = sup.s) SELECT DISTINCT x, y FROM q WHERE k = 0"),
    "REC_6_same_generation": (rules(SAME, "sg(X, Y)", "sup"), f"WITH RECURSIVE {SUP}, sg AS (SELECT x, x AS y FROM (SELECT s AS x FROM sup UNION SELECT d FROM sup) UNION SELECT a.d, b.d FROM sg JOIN sup a ON a.s = sg.x JOIN sup b ON b.s = sg.y) SELECT x, y FROM sg"),
    "REC_7_triple_store": (rules("t(X, type, D) :- t(X, type, C), t(C, sub, D). t(C, sub, E) :- t(C, sub, D), t(D, sub, E). t(X, sub, Y) :- contains(X, Y). t(C, type, N) :- contains(N, C), leafy(C).  leafy(C) :- contains(_, C), not inner(C). inner(C) :- contains(C, _).", "t(X, type, Y)", "contains"), f"WITH RECURSIVE {CONTAINS}, sub AS (SELECT x, y FROM contains UNION SELECT contains.x, sub.y FROM contains JOIN sub ON contains.y = sub.x), leaf AS (SELECT y AS x, x AS y FROM contains WHERE y NOT IN (SELECT x FROM contains)) SELECT x, y FROM leaf UNION SELECT leaf.x, sub.y FROM leaf JOIN sub ON leaf.y = sub.x"),
    "REC_8_for_all": (rules("bad(C) :- orders(_, C, S, _, _), S != \"F\". has(C) :- orders(_, C, _, _, _). allf(C) :- has(C), not bad(C).", "allf(C)", "orders"), "SELECT DISTINCT o_custkey AS c FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus <> 'F')"),
    # goal-directed
    "MAG_2_reach_magic": (rules(LINEAR, "p(7, D)", "sup", "magic"), _FROM_7_SQL),
    "MAG_1_reach_magic_left": (rules(LEFT, "p(7, D)", "sup", "magic"), _FROM_7_SQL),
    "TAB_1_reach_tabled": (rules(TWICE, "p(7, D)", "sup", "tabling"), _FROM_7_SQL),
    "TAB_2_table_reuse": (_tabled, _FROM_7_SQL),
    "MAG_3_magic_negation": (rules(LINEAR + " far(S, D) :- p(S, D), not sup(S, D).", "far(7, D)", "sup", "magic"), f"WITH RECURSIVE {FROM_7} SELECT d FROM r WHERE d NOT IN (SELECT d FROM sup WHERE s = 7)"),
    # filters, projections
    "FIL_1_constant": (rules("q(K, N) :- nation(K, N, 2).", "q(K, N)", "nation"), "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_regionkey = 2"),
    "FIL_2_repeated": (rules("q(X) :- step(X, X).", "q(X)", "step"), f"WITH {STEP} SELECT a AS x FROM step WHERE a = b"),
    "FIL_3_comparison": (rules("q(O, P) :- orders(O, _, S, P, _), P >= 30000000, S != \"O\", 5000 > O.", "q(O, P)", "orders"), "SELECT DISTINCT o_orderkey AS o, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders WHERE round(o_totalprice * 100) >= 30000000 AND o_orderstatus <> 'O' AND o_orderkey < 5000"),
    "PRJ_1_head_constants": (rules("q(K, tag, K) :- region(K, _).", "q(A, B, C)", "region"), "SELECT r_regionkey AS a, 'tag' AS b, r_regionkey AS c FROM region"),
    "PRJ_2_set_projection": (rules("q(S, P) :- orders(_, _, S, _, P).", "q(S, P)", "orders"), "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "QRY_1_query": (rules("", "nation(K, N, 3)", "nation"), "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_regionkey = 3"),
    "QRY_2_answers": (lambda spark, d: Engine(spark, "", _facts(spark, d, "snation")).answers("snation(S, 4)"), "SELECT DISTINCT s_suppkey AS c0, s_nationkey AS c1 FROM supplier WHERE s_nationkey = 4"),
    # joins
    "JOIN_1_equi": (rules("q(C, N, R) :- customer(C, K, _), nation(K, N, J), region(J, R).", "q(C, N, R)", "customer nation region"), "SELECT c_custkey AS c, n_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "JOIN_2_cross": (rules("st(S) :- orders(_, _, S, _, _). q(R, S) :- region(_, R), st(S).", "q(R, S)", "region orders"), "SELECT r_name AS r, s FROM region CROSS JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders)"),
    "JOIN_3_theta": (rules("q(A, B) :- balance(A, N, X), balance(B, N, Y), X < Y.", "q(A, B)", "balance"), "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND round(a.s_acctbal * 100) < round(b.s_acctbal * 100)"),
    "JOIN_4_triangle": (rules("q(A, B, C) :- sup(A, B), sup(B, C), sup(A, C).", "q(A, B, C)", "sup"), f"WITH {SUP} SELECT x.s AS a, x.d AS b, y.d AS c FROM sup x JOIN sup y ON x.d = y.s JOIN sup z ON z.s = x.s AND z.d = y.d"),
    "JOIN_5_anti": (rules("big(C) :- orders(_, C, _, P, _), P > 20000000. q(C) :- customer(C, _, _), not big(C).", "q(C)", "customer orders"), "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND round(o_totalprice * 100) > 20000000)"),
    "JOIN_6_semi": (rules("q(C, S) :- customer(C, _, S), orders(_, C, \"P\", _, _).", "q(C, S)", "customer orders"), "SELECT c_custkey AS c, c_mktsegment AS s FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "JOIN_7_as_of": (rules("newest(U, max(T)) :- event(U, _, T). last(U, E) :- event(U, E, T), newest(U, T).", "last(U, E)", "event"), "SELECT user_id AS u, event_id AS e FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) WHERE ts = m"),
    "JOIN_3_interval_overlap": (lambda spark, d: _overlap(spark, d), "WITH i AS (SELECT o_custkey AS c, o_orderkey AS o, o_orderdate AS f, o_orderdate + INTERVAL 10 DAY AS u FROM orders) SELECT a.o AS x, b.o AS y FROM i a JOIN i b ON a.c = b.c AND a.o < b.o AND a.f < b.u AND b.f < a.u"),
    # sets
    "SET_1_union": (rules("q(N) :- snation(_, N). q(N) :- customer(_, N, building).", "q(N)", "snation customer"), "SELECT s_nationkey AS n FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_mktsegment = 'building'"),
    "SET_2_intersect": (rules("q(N) :- snation(_, N), customer(_, N, _).", "q(N)", "snation customer"), "SELECT s_nationkey AS n FROM supplier INTERSECT SELECT c_nationkey FROM customer"),
    "SET_3_except": (rules("n(N) :- nation(N, _, _). q(N) :- n(N), not has(N). has(N) :- snation(S, N), S < 30.", "q(N)", "nation snation"), "SELECT n_nationkey AS n FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 30"),
    # aggregates
    "AGG_1_group_constant": (rules("q(all, S, count(O)) :- orders(O, _, S, _, _).", "q(A, S, N)", "orders"), "SELECT 'all' AS a, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 2"),
    "AGG_2_count_solutions": (rules("q(N, count(N)) :- customer(_, N, _).", "q(N, C)", "customer"), "SELECT c_nationkey AS n, count(*) AS c FROM (SELECT DISTINCT c_custkey, c_nationkey, c_mktsegment FROM customer) GROUP BY 1"),
    "AGG_3_sum": (rules("q(C, sum(P)) :- orders(_, C, _, P, _).", "q(C, T)", "orders"), "SELECT o_custkey AS c, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS t FROM orders GROUP BY 1"),
    "AGG_4_min": (rules("q(N, min(B)) :- balance(_, N, B).", "q(N, B)", "balance"), "SELECT s_nationkey AS n, min(CAST(round(s_acctbal * 100) AS BIGINT)) AS b FROM supplier GROUP BY 1"),
    "AGG_4_max_text": (rules("q(R, max(N)) :- nation(_, N, R).", "q(R, N)", "nation"), "SELECT n_regionkey AS r, max(n_name) AS n FROM nation GROUP BY 1"),
    "AGG_5_empty_group": (rules("q(count(O)) :- orders(O, _, nowhere, _, _).", "q(N)", "orders"), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'nowhere' HAVING count(*) > 0"),
    "AGG_6_two_rules": (rules("q(N, count(S)) :- snation(S, N). q(N, count(C)) :- customer(C, N, _).", "q(N, C)", "snation customer"), "SELECT s_nationkey AS n, count(*) AS c FROM supplier GROUP BY 1 UNION SELECT c_nationkey, count(*) FROM customer GROUP BY 1"),
    "AGG_8_over_recursion": (rules(LINEAR + " q(S, count(D)) :- p(S, D).", "q(S, N)", "sup"), f"WITH RECURSIVE {PATHS} SELECT s, count(*) AS n FROM p GROUP BY 1"),
    "AGG_9_recursive_max": (_recursive_max, f"WITH RECURSIVE {PATHS} SELECT s, max(d) AS d FROM p GROUP BY 1"),
    # negation, constraints
    "NEG_1_unreached": (rules("r(D) :- sup(7, D). r(D) :- r(M), sup(M, D). u(S) :- supplier(S), not r(S).", "u(S)", "sup supplier"), f"WITH RECURSIVE {FROM_7} SELECT s_suppkey AS s FROM supplier WHERE s_suppkey NOT IN (SELECT d FROM r)"),
    "NEG_1_zero_arity": (rules("some :- sup(1, _). none :- sup(_, 0). q(R) :- region(R, _), not none.", "q(R)", "sup region"), "SELECT r_regionkey AS r FROM region"),
    "ICN_1_violations": (_violations, f"WITH {SUP} SELECT DISTINCT a.s AS x, a.d AS y, b.d AS z FROM sup a JOIN sup b ON a.d = b.s WHERE a.s > 50 AND b.d > 90"),
    "WFS_3_win_true": (_win(0), f"{WINS} SELECT unnest(won) AS x FROM w WHERE k = 60"),
    "WFS_3_win_undefined": (_win(1), f"{WINS} SELECT x FROM (SELECT unnest(alive) AS x, won FROM w WHERE k = 60) WHERE NOT list_contains(won, x)"),
    # annotated
    "SEM_1_bool": (_semiring("bool", LINEAR, "p", None, lambda v: v.select("s", "d")), _PATHS_SQL),
    "SEM_2_cheapest": (_semiring("minplus", LINEAR, "p", "c", lambda v: v.selectExpr("s", "d", "CAST(k AS BIGINT) AS c")), f"WITH RECURSIVE {COST}, p AS (SELECT s, d, c FROM cost UNION SELECT cost.s, p.d, cost.c + p.c FROM cost JOIN p ON cost.d = p.s) SELECT s, d, CAST(min(c) AS BIGINT) AS c FROM p GROUP BY 1, 2"),
    "SEM_3_count_chains": (_semiring("count", LINEAR, "p", None, lambda v: v.selectExpr("s", "d", "CAST(k AS BIGINT) AS n")), f"WITH RECURSIVE {SUP}, p AS (SELECT s, d, 1 AS k FROM sup UNION ALL SELECT sup.s, p.d, 1 FROM sup JOIN p ON sup.d = p.s) SELECT s, d, count(*) AS n FROM p GROUP BY 1, 2"),
    "SEM_4_likeliest": (_semiring("viterbi", LINEAR, "p", "1.0D / (1 + c % 7)", lambda v: v.selectExpr("s", "d", "CAST(round(k * 1e9) AS BIGINT) AS k")), f"WITH RECURSIVE {COST}, p AS (SELECT s, d, 1.0::DOUBLE / (1 + c % 7) AS k FROM cost UNION SELECT cost.s, p.d, (1.0::DOUBLE / (1 + cost.c % 7)) * p.k FROM cost JOIN p ON cost.d = p.s) SELECT s, d, CAST(round(max(k) * 1e9) AS BIGINT) AS k FROM p GROUP BY 1, 2"),
    # updates
    "INC_1_insert": (_insert, _PATHS_SQL),
    "INC_2_delete_dred": (_delete("dred"), f"WITH RECURSIVE {SUP}, e AS (SELECT * FROM sup WHERE s % 25 <> 7), p AS (SELECT s, d FROM e UNION SELECT e.s, p.d FROM e JOIN p ON e.d = p.s) SELECT s, d FROM p"),
    "INC_3_delete_bf": (_delete("bf"), f"WITH RECURSIVE {SUP}, e AS (SELECT * FROM sup WHERE s % 25 <> 7), p AS (SELECT s, d FROM e UNION SELECT e.s, p.d FROM e JOIN p ON e.d = p.s) SELECT s, d FROM p"),
    # sources
    "SRC_5_assume": (_assumed, f"WITH RECURSIVE {SUP}, e AS (SELECT s, d FROM sup WHERE s <> 7 UNION SELECT 0, 7), p AS (SELECT s, d FROM e UNION SELECT e.s, p.d FROM e JOIN p ON e.d = p.s) SELECT s, d FROM p"),
    "SRC_7_closed_world": (_closed_world, "SELECT 'n' || a.n_nationkey AS x, 'n' || b.n_nationkey AS y FROM nation a CROSS JOIN nation b WHERE a.n_regionkey <> b.n_regionkey"),
}


def _overlap(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one customer whose ten days after the order overlap."""
    days = _table(spark, d, "orders", "o_custkey", "o_orderkey", "unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS f", "unix_micros(CAST(o_orderdate + INTERVAL 10 DAY AS TIMESTAMP)) AS u")
    e = Engine(spark, "q(X, Y) :- i(C, X, F, U), i(C, Y, G, V), X < Y, F < V, G < U.", {"i": days})
    return _lower(e.query("q(X, Y)"))


# ---------------------------------------------------------------- tools on programs


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _small_facts(df: DataFrame, pred: str, most: int = 50_000) -> str:
    """A small relation as program text; it fails on a larger one."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{pred} has more than {most} rows; use a DataFrame engine")
    return "\n".join(format_fact(pred, tuple(r)) for r in rows)


def _chase(spark: SparkSession, d: str) -> DataFrame:
    """CHS-1: every nation has a port, known or not; ports of regions without a stated one are nulls."""
    nations = _small_facts(_table(spark, d, "nation", "concat('n', n_nationkey) AS n", "concat('r', n_regionkey) AS r"), "nation")
    done = Chase(parse(nations + " port(N, p) :- nation(N, r1). port(N, P) :- nation(N, R). served(N) :- port(N, P).")).run()
    rows = [(r[0], "?" if isinstance(r[1], Null) else r[1]) for r in done.rows("port")]
    return _frame(spark, rows, "n string, p string")


def _ontology(spark: SparkSession, d: str) -> DataFrame:
    """ONT-2, ONT-4: nations below regions below the world, by the compiled completion rules on DataFrames."""
    axioms = "\n".join(f"isa({a}, {b})." for a, b in contains(spark, d).where("x LIKE 'r%'").select("y", "x").collect())
    o = Ontology(axioms + "\n" + "\n".join(f"isa(r{k}, world)." for k in range(5)))
    return o.classify_frame(spark).where("c0 != c1 AND c1 != 'nothing'").toDF("x", "y")


def _payers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The theory over a part of the suppliers at a time: no rule joins two of them."""
    rules_ = "r1: supplier(X) => pays(X). r2: debt(X) => ~pays(X). r3: seven(X) => pays(X). r2 > r1. r3 > r2."
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            rows = batch.slice(at, 1000).to_pylist()
            text = " ".join(f"supplier({r['s']})." + f" debt({r['s']})." * bool(r["debt"]) + f" seven({r['s']})." * bool(r["seven"]) for r in rows)
            found = tags(Theory.parse(text + rules_)).provable
            yield pa.RecordBatch.from_arrays([pa.array([row[0] for p, row in found if p == "pays"], pa.string())], ["s"])


def _defeasible(spark: SparkSession, d: str) -> DataFrame:
    """DEF-2: suppliers pay by default, not with debts, but in nation 7 whatever they owe."""
    facts = _table(spark, d, "supplier", "concat('s', s_suppkey) AS s", "s_acctbal < 0 AS debt", "s_nationkey = 7 AS seven")
    return facts.groupBy("s").agg(F.max("debt").alias("debt"), F.max("seven").alias("seven")).mapInArrow(_payers, "s string")


def _stable(spark: SparkSession, d: str) -> DataFrame:
    """STB-1: free choices of regions; how many models choose so many."""
    text = _small_facts(_table(spark, d, "region", "concat('r', r_regionkey) AS r"), "region")
    models = stable_models(parse(text + " on(R) :- region(R), not off(R). off(R) :- region(R), not on(R)."))
    sizes = Counter(sum(p == "on" for p, _ in m) for m in models)
    return _frame(spark, [(k, n) for k, n in sizes.items()], "chosen long, models long")


def _slg(spark: SparkSession, d: str) -> DataFrame:
    true, undefined = SlgEngine(spark, "win(X) :- hop(X, Y), not win(Y). other(X) :- hop(_, X).", {"hop": hop(spark, d)}).query("win(X)")
    return _lower(true.withColumn("state", F.lit("true")).unionByName(undefined.withColumn("state", F.lit("undefined"))))


def _why_sets(spark: SparkSession, d: str) -> DataFrame:
    """SEM-5: the facts behind every containment."""
    edges = contains(spark, d)
    values = SemiringEngine(spark, parse("p(X, Y) :- c(X, Y). p(X, Z) :- c(X, Y), p(Y, Z)."), "why", {"c": edges}).run()["p"]
    return values.selectExpr("c0 AS x", "c1 AS y", "array_join(flatten(_k), ' ') AS w")


def _incremental_tables(spark: SparkSession, d: str) -> DataFrame:
    """TAB-3: a table answered, then dropped by an update, then answered anew."""
    e = TabledEngine(spark, LINEAR.replace("sup", "edge") + " edge(S, D) :- sup(S, D). edge(S, D) :- more(S, D). more(0, 1).", {"sup": sup(spark, d)})
    e.query("p(0, D)")
    e.apply("more(0, 7). more(0, 1)~.")
    return _lower(e.query("p(0, D)"))


def _magic_constraints(spark: SparkSession, d: str) -> DataFrame:
    """MAG-3: what breaks a constraint, derived from the constraint alone."""
    e = ENGINES["magic"](spark, LINEAR + " :- p(7, D), D > 50, not sup(7, D).", {"sup": sup(spark, d)})
    return _lower(e.violations()[0][1])


def _mixed_script(spark: SparkSession, d: str) -> DataFrame:
    """INC-4: deletions first, then insertions, from one script."""
    m = Materialized(spark, LEFT + " sup(9000, 9001).", {"sup": sup(spark, d)})
    m.apply("sup(9000, 9001)~. sup(9001, 1). sup(9002, 9001).")
    return m.relations["p"].toDF("s", "d")


def _resolution(spark: SparkSession, d: str) -> DataFrame:
    found, _ = Prolog("add(0, N, N). add(s(M), N, s(R)) :- add(M, N, R).").query("add(X, Y, s(s(s(s(s(0))))))")
    return _frame(spark, [(number(x["X"]), number(x["Y"])) for x in found], "x long, y long")


def _learned(how: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """ILP: learn reachability from a few edges, then apply the rules to the suppliers' graph."""
        model = Model("sup(1, 2). sup(2, 3). sup(3, 4). sup(1, 5). sup(5, 6).")
        target, good, bad = read_examples("p(1, 2). p(2, 3). p(1, 3). p(1, 4). p(2, 4). p(3, 4). p(1, 5). p(1, 6). p(5, 6).", model)
        found = foil(model, target, good, bad) if how == "foil" else synthesise(model, candidates({"sup": 2, "p": 2}, "p", 2), target, good, bad)
        return Engine(spark, found, {"sup": sup(spark, d)}).relation("p").toDF("s", "d")

    return run


def _core(spark: SparkSession, d: str) -> DataFrame:
    """CON-3: a redundant query and its core give the same answers."""
    rule = minimise(parse("q(A, B) :- sup(A, B), sup(A, C), sup(D, B), sup(A, B).")[0])
    return _lower(Engine(spark, [rule], {"sup": sup(spark, d)}).query("q(A, B)"))


def _explained(spark: SparkSession, d: str) -> DataFrame:
    """XPL-1: why the smallest supplier that 7 reaches last is reached, a line a row."""
    model = Model(_small_facts(sup(spark, d), "sup") + "\n" + LINEAR)
    rows = [r for r in model.rows("p") if r[0] == 7] or model.rows("p")
    return _frame(spark, list(enumerate(why(model, "p", rows[-1]).lines())), "line long, text string")


def _mutated(spark: SparkSession, d: str) -> DataFrame:
    """MUT-2 and DIA-1: which changes of the closure's rules two expectations notice."""
    clauses = parse("sup(1, 2). sup(2, 3). sup(3, 4). " + LINEAR)
    caught, alive = mutation_score(clauses, *read_expectations("p(1, 4). p(1, 2). :- p(2, 1). :- p(4, _)."))
    return _frame(spark, [(x, True) for x in caught] + [(x, False) for x in alive], "mutant string, caught boolean")


_CHAIN_SQL = "WITH n AS (SELECT unnest(range(1, 61)) AS k) SELECT 'n' || a.k AS x, 'n' || b.k AS y FROM n a JOIN n b ON a.k < b.k"

ENTRIES |= {
    "SRC_1_program_text": (lambda spark, d: _lower(Engine(spark, "p(1, a). p(2, 'B b'). q(X, Y) :- p(X, Y), X > 1.").query("q(X, Y)")), "SELECT 2 AS x, 'B b' AS y"),
    "SRC_3_python_rows": (lambda spark, d: _lower(Engine(spark, "q(X) :- p(X), not r(X).", {"p": [1, 2, 2, 3], "r": [(3,)]}).query("q(X)")), "SELECT unnest([1, 2]) AS x"),
    "SRC_11_chain_closure": (lambda spark, d: _lower(Engine(spark, "p(X, Y) :- e(X, Y). p(X, Z) :- e(X, Y), p(Y, Z).", {"e": chain(spark, 60)}).query("p(X, Y)")), _CHAIN_SQL),
    "REC_1_distributed_loop": (rules(LINEAR, "p(S, D)", "sup", small_rows=0), _PATHS_SQL),
    "TAB_3_updated_tables": (_incremental_tables, f"WITH RECURSIVE {SUP}, e AS (SELECT s, d FROM sup UNION SELECT 0, 7), r AS (SELECT d FROM e WHERE s = 0 UNION SELECT e.d FROM e JOIN r ON e.s = r.d) SELECT d FROM r"),
    "INC_4_mixed_script": (_mixed_script, f"WITH RECURSIVE {SUP}, e AS (SELECT * FROM sup UNION SELECT 9001, 1 UNION SELECT 9002, 9001), p AS (SELECT s, d FROM e UNION SELECT e.s, p.d FROM e JOIN p ON e.d = p.s) SELECT s, d FROM p"),
    "SLG_1_win": (_slg, f"{WINS} SELECT unnest(won) AS x, 'true' AS state FROM w WHERE k = 60 UNION ALL SELECT x, 'undefined' FROM (SELECT unnest(alive) AS x, won FROM w WHERE k = 60) WHERE NOT list_contains(won, x)"),
    "MAG_3_magic_constraints": (_magic_constraints, f"WITH RECURSIVE {FROM_7} SELECT d FROM r WHERE d > 50 AND d NOT IN (SELECT d FROM sup WHERE s = 7)"),
    "REC_3_reach_left_distributed": (rules(LEFT, "p(S, D)", "sup", small_rows=0), _PATHS_SQL),
    "REC_4_reach_nonlinear_distributed": (rules(TWICE, "p(S, D)", "sup", small_rows=0), _PATHS_SQL),
    "REC_5_odd_even_distributed": (rules(ODD_EVEN, "even(X, Y)", "sup", small_rows=0), ENTRIES["REC_5_odd_even"][1]),
    "REC_6_same_generation_distributed": (rules(SAME, "sg(X, Y)", "sup", small_rows=0), ENTRIES["REC_6_same_generation"][1]),
    "MAG_2_reach_magic_distributed": (rules(LINEAR, "p(7, D)", "sup", "magic", small_rows=0), _FROM_7_SQL),
    "AGG_8_over_recursion_distributed": (rules(LINEAR + " q(S, count(D)) :- p(S, D).", "q(S, N)", "sup", small_rows=0), ENTRIES["AGG_8_over_recursion"][1]),
    "SEM_5_why": (_why_sets, f"WITH RECURSIVE {CONTAINS} SELECT x, y, 'c(' || x || ', ' || y || ')' AS w FROM contains UNION ALL SELECT a.x, b.y, 'c(' || b.x || ', ' || b.y || ') c(' || a.x || ', ' || a.y || ')' FROM contains a JOIN contains b ON a.y = b.x"),
    "CHS_1_chase": (_chase, "SELECT 'n' || n_nationkey AS n, CASE WHEN n_regionkey = 1 THEN 'p' ELSE '?' END AS p FROM nation"),
    "ONT_4_classify": (_ontology, "SELECT 'n' || n_nationkey AS x, 'r' || n_regionkey AS y FROM nation UNION ALL SELECT 'n' || n_nationkey, 'world' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region"),
    "DEF_2_defeasible": (_defeasible, "SELECT 's' || s_suppkey AS s FROM supplier WHERE s_acctbal >= 0 OR s_nationkey = 7"),
    "STB_1_stable_models": (_stable, "SELECT CAST(bit_count(m) AS BIGINT) AS chosen, count(*) AS models FROM (SELECT unnest(range(0, 32)) AS m) GROUP BY 1"),
    "PRO_2_resolution": (_resolution, "SELECT unnest(range(0, 6)) AS x, 5 - unnest(range(0, 6)) AS y"),
    "ILP_1_foil": (_learned("foil"), _PATHS_SQL),
    "ILP_2_synthesis": (_learned("synthesis"), _PATHS_SQL),
    "CON_3_core": (_core, f"WITH {SUP} SELECT s AS a, d AS b FROM sup"),
    "XPL_1_why": (_explained, None),
    "MUT_2_mutants": (_mutated, None),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
