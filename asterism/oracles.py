"""DuckDB SQL with the rows of each registered query, written independently of the DataFrame code."""

from __future__ import annotations

_YMD = "CAST(year({0}) * 10000 + month({0}) * 100 + day({0}) AS INTEGER)"
_MONTH = "CASE month(d) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)) + " END"

STAR = f"""
fact AS (
  SELECT l_orderkey AS lo_orderkey, l_linenumber AS lo_linenumber, o_custkey AS lo_custkey, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey,
         {_YMD.format("o_orderdate")} AS lo_orderdate, CAST(l_quantity AS INTEGER) AS lo_quantity,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS lo_extendedprice, CAST(round(l_discount * 100) AS INTEGER) AS lo_discount,
         CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS lo_revenue, CAST(round(p_retailprice * 60) AS BIGINT) AS lo_supplycost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
days AS (
  SELECT DISTINCT {_YMD.format("d")} AS d_datekey, CAST(year(d) AS INTEGER) AS d_year, CAST(year(d) * 100 + month(d) AS INTEGER) AS d_yearmonthnum,
         {_MONTH} || CAST(year(d) AS VARCHAR) AS d_yearmonth
  FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)),
cust AS (
  SELECT c_custkey, CAST(c_nationkey * 10 + c_custkey % 10 AS INTEGER) AS c_city, c_nationkey AS c_nation, n_regionkey AS c_region,
         rpad(n_name, 9, ' ') || CAST(c_custkey % 10 AS VARCHAR) AS c_city_name, n_name AS c_nation_name, r_name AS c_region_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
supp AS (
  SELECT s_suppkey, CAST(s_nationkey * 10 + s_suppkey % 10 AS INTEGER) AS s_city, s_nationkey AS s_nation, n_regionkey AS s_region,
         rpad(n_name, 9, ' ') || CAST(s_suppkey % 10 AS VARCHAR) AS s_city_name, n_name AS s_nation_name, r_name AS s_region_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
prt0 AS (SELECT p_partkey, CAST(substring(p_brand, 7) AS INTEGER) - 1 AS p_category FROM part),
prt1 AS (SELECT p_partkey, p_category, CAST(floor(p_category / 5) AS INTEGER) AS p_mfgr, CAST(p_category * 40 + p_partkey % 40 AS INTEGER) AS p_brand1 FROM prt0),
prt AS (
  SELECT *, 'MFGR#' || (p_mfgr + 1) AS p_mfgr_name, 'MFGR#' || (p_mfgr + 1) || (p_category % 5 + 1) AS p_category_name,
         'MFGR#' || (p_mfgr + 1) || (p_category % 5 + 1) || (p_brand1 % 40 + 1) AS p_brand1_name
  FROM prt1)
"""


def star(body: str) -> str:
    return f"WITH {STAR}\n{body}"


def _flight1(where: str, days: bool = False) -> str:
    join = "JOIN days ON lo_orderdate = d_datekey" if days else ""
    return star(f"SELECT CAST(sum(lo_extendedprice * lo_discount) AS BIGINT) AS revenue FROM fact {join} WHERE {where}")


def _flight2(where: str, brand: str = "p_brand1") -> str:
    return star(f"""SELECT CAST(sum(lo_revenue) AS BIGINT) AS lo_revenue, d_year, {brand}
FROM fact JOIN days ON lo_orderdate = d_datekey JOIN prt ON lo_partkey = p_partkey JOIN supp ON lo_suppkey = s_suppkey
WHERE {where} GROUP BY d_year, {brand} ORDER BY d_year, {brand}""")


def _flight3(where: str, place: str) -> str:
    return star(f"""SELECT c_{place}, s_{place}, d_year, CAST(sum(lo_revenue) AS BIGINT) AS revenue
FROM fact JOIN cust ON lo_custkey = c_custkey JOIN supp ON lo_suppkey = s_suppkey JOIN days ON lo_orderdate = d_datekey
WHERE {where} GROUP BY c_{place}, s_{place}, d_year ORDER BY d_year, revenue DESC""")


def _flight4(where: str, keys: str, measure: str = "CAST(sum(lo_revenue - lo_supplycost) AS BIGINT) AS profit") -> str:
    return star(f"""SELECT {keys}, {measure}
FROM fact JOIN cust ON lo_custkey = c_custkey JOIN supp ON lo_suppkey = s_suppkey JOIN prt ON lo_partkey = p_partkey JOIN days ON lo_orderdate = d_datekey
WHERE {where} GROUP BY {keys}""")


_Y = "d_year BETWEEN 1995 AND 2000"
_AM = "c_region = 1 AND s_region = 1 AND p_mfgr IN (0, 1)"
_AMS = "c_region_name = 'AMERICA' AND s_region_name = 'AMERICA' AND p_mfgr_name IN ('MFGR#1', 'MFGR#2')"
_CITIES = "('NATION_9 1', 'NATION_9 2')"

CODED = {
    "q11": _flight1("lo_orderdate >= 19960101 AND lo_orderdate <= 19970101 AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25"),
    "q12": _flight1("lo_orderdate BETWEEN 19970101 AND 19970131 AND lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35"),
    "q13": _flight1("lo_orderdate BETWEEN 19970204 AND 19970210 AND lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35"),
    "q21": _flight2("p_category = 1 AND s_region = 1"),
    "q22": _flight2("p_brand1 BETWEEN 260 AND 267 AND s_region = 2"),
    "q23": _flight2("p_brand1 = 260 AND s_region = 3"),
    "q31": _flight3(f"c_region = 2 AND s_region = 2 AND {_Y}", "nation"),
    "q32": _flight3(f"c_nation = 9 AND s_nation = 9 AND {_Y}", "city"),
    "q33": _flight3(f"(c_city = 91 OR c_city = 92) AND (s_city = 91 OR s_city = 92) AND {_Y}", "city"),
    "q34": _flight3("(c_city = 91 OR c_city = 97) AND (s_city = 92 OR s_city = 98) AND d_yearmonthnum = 199712", "city"),
    "q41": _flight4(_AM, "d_year, c_nation"),
    "q42": _flight4(f"{_AM} AND (d_year = 1997 OR d_year = 1998)", "d_year, s_nation, p_category"),
    "q43": _flight4("c_region = 1 AND s_nation = 24 AND (d_year = 1997 OR d_year = 1998) AND p_category = 3", "d_year, s_city, p_brand1"),
    "p1": _flight4(_AM, "d_year, c_nation", "count(*) AS n"),
    "default": star("SELECT CAST(sum(lo_revenue) AS BIGINT) AS lo_revenue FROM fact JOIN days ON lo_orderdate = d_datekey JOIN prt ON lo_partkey = p_partkey JOIN supp ON lo_suppkey = s_suppkey"),
}

STRINGS = {
    "q11": _flight1("d_year = 1996 AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25", True),
    "q12": _flight1("d_yearmonthnum = 199701 AND lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35", True),
    "q13": _flight1("d_year = 1997 AND d_yearmonthnum = 199702 AND lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35", True),
    "q21": _flight2("p_category_name = 'MFGR#12' AND s_region_name = 'AMERICA'", "p_brand1_name"),
    "q22": _flight2("p_brand1_name BETWEEN 'MFGR#2221' AND 'MFGR#2228' AND s_region_name = 'ASIA'", "p_brand1_name"),
    "q23": _flight2("p_brand1_name = 'MFGR#2221' AND s_region_name = 'EUROPE'", "p_brand1_name"),
    "q31": _flight3(f"c_region_name = 'ASIA' AND s_region_name = 'ASIA' AND {_Y}", "nation_name"),
    "q32": _flight3(f"c_nation_name = 'NATION_9' AND s_nation_name = 'NATION_9' AND {_Y}", "city_name"),
    "q33": _flight3(f"c_city_name IN {_CITIES} AND s_city_name IN {_CITIES} AND {_Y}", "city_name"),
    "q34": _flight3("c_city_name IN ('NATION_9 1', 'NATION_9 7') AND s_city_name IN ('NATION_9 2', 'NATION_9 8') AND d_yearmonth = 'Dec1997'", "city_name"),
    "q41": _flight4(_AMS, "d_year, c_nation_name"),
    "q42": _flight4(f"{_AMS} AND d_year IN (1997, 1998)", "d_year, s_nation_name, p_category_name"),
    "q43": _flight4("c_region_name = 'AMERICA' AND s_nation_name = 'NATION_24' AND d_year IN (1997, 1998) AND p_category_name = 'MFGR#14'", "d_year, s_city_name, p_brand1_name"),
}

SINGLE = {
    "scan_prune": "SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem",
    "scan_star": star("SELECT * FROM fact"),
    "dim_ddate": star("SELECT * FROM days"),
    "dim_customer": star("SELECT * FROM cust"),
    "dim_supplier": star("SELECT * FROM supp"),
    "dim_part": star("SELECT * FROM prt"),
    "filter_cmp_lit": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45",
    "filter_cmp_col": star("SELECT lo_orderkey, lo_linenumber FROM fact WHERE lo_supplycost > lo_extendedprice"),
    "filter_and": star("SELECT lo_orderkey, lo_linenumber FROM fact WHERE lo_quantity < 5 AND lo_discount <> 4 AND lo_orderdate > 19970000"),
    "filter_or": star("SELECT lo_orderkey, lo_linenumber FROM fact WHERE lo_quantity <= 2 OR lo_discount = 10"),
    "filter_nested": star("SELECT lo_orderkey, lo_linenumber FROM fact WHERE (lo_quantity < 3 OR lo_discount = 10) AND (lo_orderdate < 19960101 OR lo_orderdate >= 20000101)"),
    "filter_lit_first": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE 3 >= l_quantity",
    "search_range": star("SELECT lo_orderkey, lo_linenumber FROM fact WHERE lo_discount BETWEEN 4 AND 6"),
    "search_points": star("SELECT lo_orderkey, lo_linenumber FROM fact WHERE lo_quantity IN (1, 7, 49)"),
    "search_mixed": star("SELECT lo_orderkey, lo_linenumber FROM fact WHERE lo_quantity IN (3, 5) OR (lo_quantity > 20 AND lo_quantity < 23) OR lo_quantity >= 49"),
    "flag_count": star("SELECT count(*) AS survivors FROM fact WHERE lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25"),
    "join_semi": star("SELECT lo_orderkey, lo_linenumber FROM fact WHERE lo_suppkey IN (SELECT s_suppkey FROM supp WHERE s_region = 1)"),
    "join_lookup": star("SELECT lo_orderkey, lo_linenumber, p_brand1 FROM fact JOIN prt ON lo_partkey = p_partkey WHERE p_category = 1"),
    "join_star_mixed": star("SELECT lo_orderkey, lo_linenumber, d_year, c_nation FROM fact JOIN cust ON lo_custkey = c_custkey JOIN days ON lo_orderdate = d_datekey JOIN supp ON lo_suppkey = s_suppkey WHERE s_region = 3 AND c_region = 2"),
    "project_ref": star("SELECT lo_revenue, lo_orderkey FROM fact"),
    "project_lit": "SELECT l_orderkey, l_linenumber, 7 AS seven FROM lineitem",
    "project_colcol": star("SELECT lo_orderkey, lo_linenumber, lo_extendedprice * lo_discount AS product, lo_revenue - lo_supplycost AS profit, lo_revenue + lo_supplycost AS total FROM fact"),
    "project_litcol": star("SELECT lo_orderkey, lo_linenumber, CAST(100 - lo_discount AS BIGINT) AS rest FROM fact"),
    "project_collit": star("SELECT lo_orderkey, lo_linenumber, CAST(lo_quantity * 3 AS BIGINT) AS thrice FROM fact"),
    "project_div": star("SELECT lo_orderkey, lo_linenumber, lo_extendedprice // 100 AS units FROM fact"),
    "agg_sum": star("SELECT CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM fact"),
    "agg_sum_empty": star("SELECT CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM fact WHERE lo_quantity > 1000"),
    "agg_sum_zero": "SELECT CAST(0 AS BIGINT) AS revenue",
    "agg_group1": star("SELECT lo_discount, CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM fact GROUP BY lo_discount"),
    "agg_group2": star("SELECT d_year, lo_discount, CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM fact JOIN days ON lo_orderdate = d_datekey GROUP BY d_year, lo_discount"),
    "agg_group3": star("SELECT d_year, lo_discount, lo_quantity, CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM fact JOIN days ON lo_orderdate = d_datekey GROUP BY d_year, lo_discount, lo_quantity"),
    "agg_count": star("SELECT lo_discount, count(*) AS n FROM fact GROUP BY lo_discount"),
    "agg_minmax": star("SELECT min(lo_revenue) AS least, max(lo_revenue) AS most, min(lo_orderdate) AS first_day, max(lo_orderdate) AS last_day FROM fact"),
    "sort_multi": star("SELECT d_year, lo_discount, CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM fact JOIN days ON lo_orderdate = d_datekey GROUP BY d_year, lo_discount ORDER BY d_year, revenue DESC"),
    "encode_roundtrip": star("SELECT p_partkey, p_mfgr, p_category, p_brand1, p_brand1_name FROM prt"),
    "int32_columns": star("SELECT CAST(lo_orderkey AS INTEGER) AS lo_orderkey, lo_linenumber, CAST(lo_custkey AS INTEGER) AS lo_custkey, CAST(lo_partkey AS INTEGER) AS lo_partkey, CAST(lo_suppkey AS INTEGER) AS lo_suppkey, lo_orderdate, lo_quantity, CAST(lo_extendedprice AS INTEGER) AS lo_extendedprice, lo_discount, CAST(lo_revenue AS INTEGER) AS lo_revenue, CAST(lo_supplycost AS INTEGER) AS lo_supplycost FROM fact"),
    "delimited_table": star("SELECT CAST(lo_orderkey AS INTEGER) AS lo_orderkey, lo_linenumber, CAST(lo_custkey AS INTEGER) AS lo_custkey, '-' AS lo_orderpriority, lo_quantity, CAST(lo_revenue AS INTEGER) AS lo_revenue FROM fact"),
}

SQL = {
    **{f"ssb_{k}": v for k, v in CODED.items()},
    **{f"ssb_str_{k}": v for k, v in STRINGS.items()},
    **{f"{form}_{k}": v for form in ("plan_ir", "sql") for k, v in CODED.items()},
    **{f"files_int32_{k}": CODED[k] for k in ("q11", "q21", "q31", "q41")},
    **{f"files_coded_{k}": CODED[k] for k in ("q12", "q22")},
    **{f"files_strings_{k}": STRINGS[k] for k in ("q12", "q22", "q31")},
    **SINGLE,
}
