"""The plan format: JSON, usage analysis, and compiling, decision by decision."""

import pytest

from asterism.functions.predicates import Range
from asterism.plans import examples
from asterism.plans.compile import compile_plan
from asterism.plans.ir import Aggregate, Call, Col, Filter, Join, Key, Lit, Measure, Plan, Project, Scan, Search, Sort
from asterism.plans.usage import order, semi_joins, used, widths


@pytest.fixture
def table(spark):
    data = {
        "fact": spark.createDataFrame([(k, k % 3, k * 10) for k in range(8)], "k int, d int, q int"),
        "dim": spark.createDataFrame([(1, 10), (2, 20), (2, 21), (9, 90)], "key int, grp int"),
        "none": spark.createDataFrame([], "k int, d int, q int"),
    }
    return lambda name, columns: data[name].select(*columns)


def run(plan, table):
    return sorted(map(tuple, compile_plan(plan, table).collect()), key=repr)


def fact(plan, name="fact"):
    return plan.add(Scan(name, ("k", "d", "q")))


def test_json_round_trip():
    for make in examples.PLANS.values():
        assert Plan.from_json(make().to_json()).nodes == make().nodes
    with pytest.raises(ValueError):
        Plan.from_json('[{"op": "union"}]')


def test_nodes_come_after_their_inputs():
    with pytest.raises(ValueError):
        Plan().add(Filter(0, Lit(1)))


def test_stacked_filters_and_having(table):
    p = Plan()
    f = p.add(Filter(p.add(Filter(fact(p), Call(">", (Col(0), Lit(1))))), Call("<", (Lit(20), Col(2)))))
    a = p.add(Aggregate(f, (1,), (Measure("SUM", 2, "s"), Measure("COUNT", None, "n"))))
    p.add(Filter(a, Call(">=", (Col(1), Lit(100)))))
    assert run(p, table) == [(0, 90, 2), (1, 110, 2), (2, 50, 1)][1:2]


@pytest.mark.parametrize("kind, n", [("inner", 3), ("left", 9), ("right", 4), ("full", 10), ("semi", 2), ("anti", 6)])
def test_join_kinds(table, kind, n):
    p = Plan()
    p.add(Join(fact(p), p.add(Scan("dim", ("key", "grp"))), 0, 0, kind))
    assert len(run(p, table)) == n
    bad = Plan()
    bad.add(Join(fact(bad), bad.add(Scan("dim", ("key",))), 0, 0, "cross"))
    with pytest.raises(ValueError):
        compile_plan(bad, table)


def test_semi_join_keeps_positions(table):
    p = Plan()
    j = p.add(Join(fact(p), p.add(Scan("dim", ("key", "grp"))), 0, 0, "semi"))
    j = p.add(Join(j, p.add(Scan("dim", ("key", "grp"))), 0, 0))
    p.add(Project(j, (Col(0), Col(6)), ("k", "grp")))
    assert run(p, table) == [(1, 10), (2, 20), (2, 21)]
    p.nodes[-1] = Project(j, (Col(4),), ("hidden",))
    with pytest.raises(ValueError):
        compile_plan(p, table)


def test_same_table_twice_and_on_both_sides(table):
    p = Plan()
    a, b = fact(p), fact(p)
    p.add(Project(p.add(Join(a, b, 0, 1)), (Col(0), Col(3)), ("x", "y")))
    assert len(run(p, table)) == 8
    q = Plan()
    a = fact(q)
    q.add(Project(q.add(Join(a, a, 0, 0)), (Col(0), Col(5)), ("x", "y")))
    assert run(q, table) == [(k, k * 10) for k in range(8)]


def test_empty_input(table):
    p = Plan()
    p.add(Aggregate(fact(p, "none"), (), (Measure("SUM", 2, "s"),)))
    assert run(p, table) == [(None,)]
    p.nodes[-1] = Aggregate(0, (), (Measure("SUM", 2, "s"),), zero_if_empty=True)
    assert run(p, table) == [(0,)]
    p.nodes[-1] = Aggregate(0, (1,), (Measure("SUM", 2, "s"),), zero_if_empty=True)
    assert run(p, table) == []


def test_aggregates(table):
    p = Plan()
    p.add(Aggregate(fact(p), (), tuple(Measure(f, 1, f) for f in ("SUM", "COUNT", "MIN", "MAX", "AVG")) + (Measure("COUNT", 1, "d", True), Measure("SUM", 1, "sd", True))))
    assert run(p, table) == [(7, 8, 0, 2, 0.875, 3, 3)]
    p.nodes[-1] = Aggregate(0, (), (Measure("MEDIAN", 1),))
    with pytest.raises(ValueError):
        compile_plan(p, table)


def test_nested_expressions(table):
    p = Plan()
    e = Call("*", (Call("-", (Lit(100), Col(0))), Call("+", (Col(1), Lit(1)))))
    p.add(Project(p.add(Filter(fact(p), Call("NOT", (Search(Col(0), (Range(2, 7),)),)))), (e, Lit(5)), ("e", "five")))
    assert run(p, table) == [(100, 5), (198, 5)]


def test_sort_and_repeated_columns(table):
    p = Plan()
    p.add(Sort(p.add(Project(fact(p), (Col(1), Col(0), Col(1)), ("d", "k", "d2"))), (Key(0, True), Key(1))))
    assert [tuple(r) for r in compile_plan(p, table).collect()][:3] == [(2, 2, 2), (2, 5, 2), (1, 1, 1)]


def test_usage():
    plan = examples.q21()
    assert widths(plan)[-1] == 3 and used(plan)[-1] == {0, 1, 2}
    read = {n.table: {n.columns[i] for i in x} for n, x in zip(plan.nodes, used(plan)) if isinstance(n, Scan)}
    assert read == {"supplier": {"s_suppkey", "s_region"}, "part": {"p_partkey", "p_category", "p_brand1"}, "ddate": {"d_datekey", "d_year"}, "lineorder": {"lo_orderdate", "lo_partkey", "lo_suppkey", "lo_revenue"}}
    kinds = [n.kind for n in semi_joins(plan, examples.UNIQUE).nodes if isinstance(n, Join)]
    assert kinds == ["semi", "inner", "inner"]
    assert [n.kind for n in semi_joins(plan, set()).nodes if isinstance(n, Join)] == ["inner"] * 3


def test_order_puts_the_fact_late():
    plan = examples.q21()
    at = order(plan, "lineorder")
    scans = [i for i in at if isinstance(plan.nodes[i], Scan)]
    assert plan.nodes[scans[-1]].table == "lineorder" and sorted(at) == list(range(len(plan.nodes)))


def test_nodes_that_nothing_reads_are_not_compiled(table):
    p = Plan()
    p.add(Scan("no such table", ("x",)))
    f = fact(p)
    p.add(Aggregate(f, (), (Measure("COUNT", None, "n"),)))
    assert order(p, "fact") == [1, 2] and run(p, table) == [(8,)]
