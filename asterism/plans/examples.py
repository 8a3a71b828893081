"""Plans of the queries, written out as nodes."""

from __future__ import annotations

from ..functions.predicates import Range
from .ir import Aggregate, Call, Col, Filter, Join, Key, Lit, Measure, Plan, Project, Scan, Search, Sort

#: Dimension keys that do not repeat.
UNIQUE = {("ddate", "d_datekey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")}


def _scan(plan: Plan, table: str, columns: str, condition=None) -> int:
    at = plan.add(Scan(table, tuple(columns.split())))
    return at if condition is None else plan.add(Filter(at, condition))


def _equal(at: int, value: int) -> Call:
    return Call("=", (Col(at), Lit(value)))


def _points(at: int, *values: int) -> Search:
    return Search(Col(at), tuple(Range(v, v) for v in values))


def _flight1(days: Range, discount: Range, quantity) -> Plan:
    p = Plan()
    condition = Call("AND", (Search(Col(0), (days,)), Search(Col(1), (discount,)), quantity))
    f = _scan(p, "lineorder", "lo_orderdate lo_discount lo_quantity lo_extendedprice", condition)
    p.add(Aggregate(p.add(Project(f, (Call("*", (Col(3), Col(1))),), ("product",))), (), (Measure("SUM", 0, "revenue"),)))
    return p


def q11() -> Plan:
    return _flight1(Range(19960101, 19970101), Range(1, 3), Call("<", (Col(2), Lit(25))))


def q12() -> Plan:
    return _flight1(Range(19970101, 19970131), Range(4, 6), Search(Col(2), (Range(26, 35),)))


def q13() -> Plan:
    return _flight1(Range(19970204, 19970210), Range(5, 7), Search(Col(2), (Range(26, 35),)))


def _flight2(part, region: int) -> Plan:
    p = Plan()
    supplier = _scan(p, "supplier", "s_suppkey s_region", _equal(1, region))
    parts = _scan(p, "part", "p_partkey p_category p_brand1", part)
    days = _scan(p, "ddate", "d_datekey d_year")
    f = _scan(p, "lineorder", "lo_orderdate lo_partkey lo_suppkey lo_revenue")
    f = p.add(Join(f, supplier, 2, 0))  # 4-5
    f = p.add(Join(f, parts, 1, 0))  # 6-8
    f = p.add(Join(f, days, 0, 0))  # 9-10
    f = p.add(Aggregate(f, (10, 8), (Measure("SUM", 3, "lo_revenue"),)))
    f = p.add(Project(f, (Col(2), Col(0), Col(1)), ("lo_revenue", "d_year", "p_brand1")))
    p.add(Sort(f, (Key(1), Key(2))))
    return p


def q21() -> Plan:
    return _flight2(_equal(1, 1), 1)


def q22() -> Plan:
    return _flight2(Search(Col(2), (Range(260, 267),)), 2)


def q23() -> Plan:
    return _flight2(_equal(2, 260), 3)


def _flight3(place: str, by: str, customer, supplier, days: str, when) -> Plan:
    """place: what is grouped by, position 1; by: position 2; when: a condition on position 1 of the days."""
    p = Plan()
    customers = _scan(p, "customer", f"c_custkey c_{place} c_{by}", customer)
    suppliers = _scan(p, "supplier", f"s_suppkey s_{place} s_{by}", supplier)
    dates = _scan(p, "ddate", days, when)
    f = _scan(p, "lineorder", "lo_orderdate lo_custkey lo_suppkey lo_revenue")
    f = p.add(Join(f, customers, 1, 0))  # 4-6
    f = p.add(Join(f, suppliers, 2, 0))  # 7-9
    f = p.add(Join(f, dates, 0, 0))  # 10-
    f = p.add(Aggregate(f, (5, 8, 10 + days.split().index("d_year")), (Measure("SUM", 3, "revenue"),)))
    p.add(Sort(f, (Key(2), Key(3, descending=True))))
    return p


_YEARS = ("d_datekey d_year", Search(Col(1), (Range(1995, 2000),)))


def q31() -> Plan:
    return _flight3("nation", "region", _equal(2, 2), _equal(2, 2), *_YEARS)


def q32() -> Plan:
    return _flight3("city", "nation", _equal(2, 9), _equal(2, 9), *_YEARS)


def q33() -> Plan:
    return _flight3("city", "nation", _points(1, 91, 92), _points(1, 91, 92), *_YEARS)


def q34() -> Plan:
    return _flight3("city", "nation", _points(1, 91, 97), _points(1, 92, 98), "d_datekey d_yearmonthnum d_year", _equal(1, 199712))


def _flight4(customer: str, supplier: str, suppliers, part: str, parts, days, group: tuple[int, ...], names: tuple[str, ...], count: bool = False) -> Plan:
    """group: positions after all joins, of which supplier's begin at 6, part's at 9, customer's at 12 and the day's at 15."""
    p = Plan()
    c = _scan(p, "customer", customer, _equal(2, 1))
    s = _scan(p, "supplier", supplier, suppliers)
    parts = _scan(p, "part", part, parts)
    dates = _scan(p, "ddate", "d_datekey d_year", days)
    f = _scan(p, "lineorder", "lo_orderdate lo_custkey lo_suppkey lo_partkey lo_revenue lo_supplycost")
    f = p.add(Join(f, s, 2, 0))
    f = p.add(Join(f, parts, 3, 0))
    f = p.add(Join(f, c, 1, 0))
    f = p.add(Join(f, dates, 0, 0))
    if count:
        p.add(Aggregate(f, group, (Measure("COUNT", None, "n"),)))
        return p
    f = p.add(Project(f, (*map(Col, group), Call("-", (Col(4), Col(5)))), (*names, "profit")))
    f = p.add(Aggregate(f, tuple(range(len(group))), (Measure("SUM", len(group), "profit"),)))
    p.add(Sort(f, tuple(map(Key, range(len(group))))))
    return p


_AMERICA = ("c_custkey c_nation c_region", "s_suppkey s_nation s_region", _equal(2, 1), "p_partkey p_category p_mfgr", _points(2, 0, 1))


def q41() -> Plan:
    return _flight4(*_AMERICA, None, (16, 13), ("d_year", "c_nation"))


def q42() -> Plan:
    return _flight4(*_AMERICA, _points(1, 1997, 1998), (16, 7, 10), ("d_year", "s_nation", "p_category"))


def q43() -> Plan:
    return _flight4("c_custkey c_nation c_region", "s_suppkey s_city s_nation", _equal(2, 24), "p_partkey p_brand1 p_category", _equal(2, 3), _points(1, 1997, 1998), (16, 7, 10), ("d_year", "s_city", "p_brand1"))


def p1() -> Plan:
    return _flight4(*_AMERICA, None, (16, 13), ("d_year", "c_nation"), count=True)


def default() -> Plan:
    p = Plan()
    sides = [_scan(p, table, columns) for table, columns in (("ddate", "d_datekey"), ("part", "p_partkey"), ("supplier", "s_suppkey"))]
    f = _scan(p, "lineorder", "lo_orderdate lo_partkey lo_suppkey lo_revenue")
    for key, side in enumerate(sides):
        f = p.add(Join(f, side, key, 0))
    p.add(Aggregate(f, (), (Measure("SUM", 3, "lo_revenue"),)))
    return p


PLANS = {f.__name__: f for f in (q11, q12, q13, q21, q22, q23, q31, q32, q33, q34, q41, q42, q43, p1, default)}
