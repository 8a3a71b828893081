"""Queries as SQL text over the registered star views."""

_FLIGHT2 = """
        SELECT CAST(sum(lo_revenue) AS BIGINT) AS lo_revenue, d_year, p_brand1 FROM lineorder, ddate, part, supplier
        WHERE lo_orderdate = d_datekey AND lo_partkey = p_partkey AND lo_suppkey = s_suppkey AND {}
        GROUP BY d_year, p_brand1 ORDER BY d_year, p_brand1"""
_FLIGHT3 = """
        SELECT c_{0}, s_{0}, d_year, CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM customer, lineorder, supplier, ddate
        WHERE lo_custkey = c_custkey AND lo_suppkey = s_suppkey AND lo_orderdate = d_datekey AND {1}
        GROUP BY c_{0}, s_{0}, d_year ORDER BY d_year ASC, revenue DESC"""
_FLIGHT4 = """
        FROM ddate, customer, supplier, part, lineorder
        WHERE lo_custkey = c_custkey AND lo_suppkey = s_suppkey AND lo_partkey = p_partkey AND lo_orderdate = d_datekey
          AND c_region = 1 AND s_region = 1 AND (p_mfgr = 0 OR p_mfgr = 1)"""

# The thirteen queries, a count, and the plain total.
TEXTS = {
    "q11": """
        SELECT CAST(sum(CAST(lo_extendedprice AS BIGINT) * lo_discount) AS BIGINT) AS revenue FROM lineorder
        WHERE lo_orderdate >= 19960101 AND lo_orderdate <= 19970101 AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25""",
    "q13": """
        SELECT CAST(sum(CAST(lo_extendedprice AS BIGINT) * lo_discount) AS BIGINT) AS revenue FROM lineorder
        WHERE lo_orderdate >= 19970204 AND lo_orderdate <= 19970210 AND lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35""",
    "q21": _FLIGHT2.format("p_category = 1 AND s_region = 1"),
    "q23": _FLIGHT2.format("p_brand1 = 260 AND s_region = 3"),
    "q31": _FLIGHT3.format("nation", "c_region = 2 AND s_region = 2 AND d_year >= 1995 AND d_year <= 2000"),
    "q32": _FLIGHT3.format("city", "c_nation = 9 AND s_nation = 9 AND d_year >= 1995 AND d_year <= 2000"),
    "q34": _FLIGHT3.format("city", "(c_city = 91 OR c_city = 97) AND (s_city = 92 OR s_city = 98) AND d_yearmonthnum = 199712"),
    "q41": f"SELECT d_year, c_nation, CAST(sum(lo_revenue - lo_supplycost) AS BIGINT) AS profit {_FLIGHT4} GROUP BY d_year, c_nation ORDER BY d_year, c_nation",
    "q42": f"""
        SELECT d_year, s_nation, p_category, CAST(sum(lo_revenue - lo_supplycost) AS BIGINT) AS profit {_FLIGHT4}
          AND (d_year = 1997 OR d_year = 1998) GROUP BY d_year, s_nation, p_category ORDER BY d_year, s_nation, p_category""",
    "p1": f"SELECT d_year, c_nation, count(*) AS n {_FLIGHT4} GROUP BY d_year, c_nation",
    "q12": """
        SELECT CAST(sum(CAST(lo_extendedprice AS BIGINT) * lo_discount) AS BIGINT) AS revenue FROM lineorder
        WHERE lo_orderdate >= 19970101 AND lo_orderdate <= 19970131 AND lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35""",
    "q22": """
        SELECT CAST(sum(lo_revenue) AS BIGINT) AS lo_revenue, d_year, p_brand1 FROM lineorder, ddate, part, supplier
        WHERE lo_orderdate = d_datekey AND lo_partkey = p_partkey AND lo_suppkey = s_suppkey AND p_brand1 BETWEEN 260 AND 267 AND s_region = 2
        GROUP BY d_year, p_brand1 ORDER BY d_year, p_brand1""",
    "q33": """
        SELECT c_city, s_city, d_year, CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM customer, lineorder, supplier, ddate
        WHERE lo_custkey = c_custkey AND lo_suppkey = s_suppkey AND lo_orderdate = d_datekey AND (c_city = 91 OR c_city = 92) AND (s_city = 91 OR s_city = 92)
          AND d_year >= 1995 AND d_year <= 2000
        GROUP BY c_city, s_city, d_year ORDER BY d_year ASC, revenue DESC""",
    "q43": """
        SELECT d_year, s_city, p_brand1, CAST(sum(lo_revenue - lo_supplycost) AS BIGINT) AS profit FROM ddate, customer, supplier, part, lineorder
        WHERE lo_custkey = c_custkey AND lo_suppkey = s_suppkey AND lo_partkey = p_partkey AND lo_orderdate = d_datekey
          AND c_region = 1 AND s_nation = 24 AND (d_year = 1997 OR d_year = 1998) AND p_category = 3
        GROUP BY d_year, s_city, p_brand1 ORDER BY d_year, s_city, p_brand1""",
    "default": """
        SELECT CAST(sum(lo_revenue) AS BIGINT) AS lo_revenue FROM lineorder, ddate, part, supplier
        WHERE lo_orderdate = d_datekey AND lo_partkey = p_partkey AND lo_suppkey = s_suppkey""",
}
