"""The benchmark's thirteen queries, coded and with strings, a count, and a plain total, on the driver's data.

Literals are shifted to years and places that these data have; the shapes are the
benchmark's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.arith import operate
from .sources.starviews import Bounds, Star

C = F.col


def _between(name: str, low, high) -> Column:
    return C(name).between(low, high)


def _revenue(name: str = "lo_revenue", value: Column | None = None) -> Column:
    return F.sum(C("lo_revenue") if value is None else value).cast("bigint").alias(name)


# --- flight 1: a filtered fact table, one sum of products -------------------------------


def _within(bounds: Bounds) -> Column:
    out = None
    for name, low, high in bounds:
        x = C(name) <= high if low is None else C(name) >= low if high is None else _between(name, low, high)
        out = x if out is None else out & x
    return out


def _flight1(star: Star, bounds: Bounds, by_date: Column | None = None) -> DataFrame:
    q = star.query(["lo_orderdate", "lo_discount", "lo_quantity", "lo_extendedprice"], bounds).where(_within(bounds))
    if by_date is not None:
        q = q.dimension(star.ddate(), "d_datekey", "lo_orderdate", by_date)
    return q.aggregate(_revenue("revenue", operate("*", C("lo_extendedprice"), C("lo_discount")))).frame()


def q11(star: Star) -> DataFrame:
    return _flight1(star, [("lo_orderdate", 19960101, 19970101), ("lo_discount", 1, 3), ("lo_quantity", None, 24)])


def q12(star: Star) -> DataFrame:
    return _flight1(star, [("lo_orderdate", 19970101, 19970131), ("lo_discount", 4, 6), ("lo_quantity", 26, 35)])


def q13(star: Star) -> DataFrame:
    return _flight1(star, [("lo_orderdate", 19970204, 19970210), ("lo_discount", 5, 7), ("lo_quantity", 26, 35)])


def str_q11(star: Star) -> DataFrame:
    return _flight1(star, [("lo_discount", 1, 3), ("lo_quantity", None, 24)], C("d_year") == 1996)


def str_q12(star: Star) -> DataFrame:
    return _flight1(star, [("lo_discount", 4, 6), ("lo_quantity", 26, 35)], C("d_yearmonthnum") == 199701)


def str_q13(star: Star) -> DataFrame:
    return _flight1(star, [("lo_discount", 5, 7), ("lo_quantity", 26, 35)], (C("d_year") == 1997) & (C("d_yearmonthnum") == 199702))


# --- flight 2: revenue by year and brand ------------------------------------------------


def _flight2(star: Star, part: Column, supplier: Column, brand: str = "p_brand1", region: str = "s_region") -> DataFrame:
    return (
        star.query(["lo_orderdate", "lo_partkey", "lo_suppkey", "lo_revenue"])
        .dimension(star.dimension("supplier", region), "s_suppkey", "lo_suppkey", supplier)
        .dimension(star.part(), "p_partkey", "lo_partkey", part, [brand])
        .dimension(star.ddate(), "d_datekey", "lo_orderdate", None, ["d_year"])
        .aggregate(_revenue(), by=["d_year", brand])
        .select("lo_revenue", "d_year", brand)
        .order_by("d_year", brand)
        .frame()
    )


def q21(star: Star) -> DataFrame:
    return _flight2(star, C("p_category") == 1, C("s_region") == 1)


def q22(star: Star) -> DataFrame:
    return _flight2(star, _between("p_brand1", 260, 267), C("s_region") == 2)


def q23(star: Star) -> DataFrame:
    return _flight2(star, C("p_brand1") == 260, C("s_region") == 3)


def str_q21(star: Star) -> DataFrame:
    return _flight2(star, C("p_category_name") == "MFGR#12", C("s_region_name") == "AMERICA", "p_brand1_name", "s_region_name")


def str_q22(star: Star) -> DataFrame:
    return _flight2(star, _between("p_brand1_name", "MFGR#2221", "MFGR#2228"), C("s_region_name") == "ASIA", "p_brand1_name", "s_region_name")


def str_q23(star: Star) -> DataFrame:
    return _flight2(star, C("p_brand1_name") == "MFGR#2221", C("s_region_name") == "EUROPE", "p_brand1_name", "s_region_name")


# --- flight 3: revenue by customer place, supplier place and year -----------------------


def _flight3(star: Star, customer: Column, supplier: Column, day: Column, place: str, by: str | None = None) -> DataFrame:
    def side(table: str, prefix: str) -> DataFrame:
        return star.dimension(table, *{f"{prefix}_{x}" for x in (place, by or place)})

    return (
        star.query(["lo_orderdate", "lo_custkey", "lo_suppkey", "lo_revenue"])
        .dimension(side("customer", "c"), "c_custkey", "lo_custkey", customer, [f"c_{place}"])
        .dimension(side("supplier", "s"), "s_suppkey", "lo_suppkey", supplier, [f"s_{place}"])
        .dimension(star.ddate(), "d_datekey", "lo_orderdate", day, ["d_year"])
        .aggregate(_revenue("revenue"), by=[f"c_{place}", f"s_{place}", "d_year"])
        .order_by(C("d_year").asc(), C("revenue").desc())
        .frame()
    )



def _years() -> Column:
    return _between("d_year", 1995, 2000)


def q31(star: Star) -> DataFrame:
    return _flight3(star, C("c_region") == 2, C("s_region") == 2, _years(), "nation", "region")


def q32(star: Star) -> DataFrame:
    return _flight3(star, C("c_nation") == 9, C("s_nation") == 9, _years(), "city", "nation")


def q33(star: Star) -> DataFrame:
    return _flight3(star, C("c_city").isin(91, 92), C("s_city").isin(91, 92), _years(), "city")


def q34(star: Star) -> DataFrame:
    return _flight3(star, C("c_city").isin(91, 97), C("s_city").isin(92, 98), C("d_yearmonthnum") == 199712, "city")


def str_q31(star: Star) -> DataFrame:
    return _flight3(star, C("c_region_name") == "ASIA", C("s_region_name") == "ASIA", _years(), "nation_name", "region_name")


def str_q32(star: Star) -> DataFrame:
    return _flight3(star, C("c_nation") == 9, C("s_nation") == 9, _years(), "city_name", "nation")


def str_q33(star: Star) -> DataFrame:
    cities = ["NATION_9 1", "NATION_9 2"]
    return _flight3(star, C("c_city_name").isin(cities), C("s_city_name").isin(cities), _years(), "city_name")


def str_q34(star: Star) -> DataFrame:
    return _flight3(star, C("c_city_name").isin("NATION_9 1", "NATION_9 7"), C("s_city_name").isin("NATION_9 2", "NATION_9 8"), C("d_yearmonth") == "Dec1997", "city_name")


# --- flight 4: profit -------------------------------------------------------------------


def _flight4(star: Star, customer: Column, supplier: Column, part: Column, day: Column | None, keys: list[str], by: tuple[str, str] = ("c_region", "s_region"), measure: Column | None = None, ordered: bool = True) -> DataFrame:
    def own(prefix: str) -> list[str]:
        return [k for k in keys if k.startswith(prefix)]

    profit = F.sum(operate("-", C("lo_revenue"), C("lo_supplycost"))).cast("bigint").alias("profit")
    cost = [] if measure is not None else ["lo_supplycost"]
    q = (
        star.query(["lo_orderdate", "lo_custkey", "lo_suppkey", "lo_partkey", "lo_revenue", *cost])
        .dimension(star.dimension("customer", by[0], *own("c_")), "c_custkey", "lo_custkey", customer, own("c_"))
        .dimension(star.dimension("supplier", by[1], *own("s_")), "s_suppkey", "lo_suppkey", supplier, own("s_"))
        .dimension(star.part(), "p_partkey", "lo_partkey", part, own("p_"))
        .dimension(star.ddate(), "d_datekey", "lo_orderdate", day, ["d_year"])
        .aggregate(profit if measure is None else measure, by=keys)
    )
    return (q.order_by(*keys) if ordered else q).frame()


def q41(star: Star) -> DataFrame:
    return _flight4(star, C("c_region") == 1, C("s_region") == 1, C("p_mfgr").isin(0, 1), None, ["d_year", "c_nation"])


def q42(star: Star) -> DataFrame:
    return _flight4(star, C("c_region") == 1, C("s_region") == 1, C("p_mfgr").isin(0, 1), C("d_year").isin(1997, 1998), ["d_year", "s_nation", "p_category"])


def q43(star: Star) -> DataFrame:
    return _flight4(star, C("c_region") == 1, C("s_nation") == 24, C("p_category") == 3, C("d_year").isin(1997, 1998), ["d_year", "s_city", "p_brand1"], ("c_region", "s_nation"))


def str_q41(star: Star) -> DataFrame:
    return _flight4(star, C("c_region_name") == "AMERICA", C("s_region_name") == "AMERICA", C("p_mfgr_name").isin("MFGR#1", "MFGR#2"), None, ["d_year", "c_nation_name"], ("c_region_name", "s_region_name"))


def str_q42(star: Star) -> DataFrame:
    return _flight4(star, C("c_region_name") == "AMERICA", C("s_region_name") == "AMERICA", C("p_mfgr_name").isin("MFGR#1", "MFGR#2"), C("d_year").isin(1997, 1998), ["d_year", "s_nation_name", "p_category_name"], ("c_region_name", "s_region_name"))


def str_q43(star: Star) -> DataFrame:
    return _flight4(star, C("c_region_name") == "AMERICA", C("s_nation") == 24, C("p_category_name") == "MFGR#14", C("d_year").isin(1997, 1998), ["d_year", "s_city_name", "p_brand1_name"], ("c_region_name", "s_nation"))


def p1(star: Star) -> DataFrame:
    return _flight4(star, C("c_region") == 1, C("s_region") == 1, C("p_mfgr").isin(0, 1), None, ["d_year", "c_nation"], measure=F.count(F.lit(1)).alias("n"), ordered=False)


def default(star: Star) -> DataFrame:
    return (
        star.query(["lo_orderdate", "lo_partkey", "lo_suppkey", "lo_revenue"])
        .dimension(star.ddate(), "d_datekey", "lo_orderdate")
        .dimension(star.part(), "p_partkey", "lo_partkey")
        .dimension(star.dimension("supplier", "s_city"), "s_suppkey", "lo_suppkey")
        .aggregate(_revenue())
        .frame()
    )


CODED: dict[str, Callable[[Star], DataFrame]] = {f.__name__: f for f in (q11, q12, q13, q21, q22, q23, q31, q32, q33, q34, q41, q42, q43, p1, default)}
STRINGS: dict[str, Callable[[Star], DataFrame]] = {f.__name__.removeprefix("str_"): f for f in (str_q11, str_q12, str_q13, str_q21, str_q22, str_q23, str_q31, str_q32, str_q33, str_q34, str_q41, str_q42, str_q43)}
