"""Schemas of the five star tables, with dimension attributes as strings or as integer codes."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names in the order of the benchmark's tables; i integer, s string.
_COLUMNS = {
    "lineorder": "lo_orderkey:i lo_linenumber:i lo_custkey:i lo_partkey:i lo_suppkey:i lo_orderdate:i lo_orderpriority:s lo_shippriority:s lo_quantity:i lo_extendedprice:i lo_ordtotalprice:i lo_discount:i lo_revenue:i lo_supplycost:i lo_tax:i lo_commitdate:i lo_shopmode:s",
    "part": "p_partkey:i p_name:s p_mfgr:s p_category:s p_brand1:s p_color:s p_type:s p_size:i p_container:s",
    "supplier": "s_suppkey:i s_name:s s_address:s s_city:s s_nation:s s_region:s s_phone:s",
    "customer": "c_custkey:i c_name:s c_address:s c_city:s c_nation:s c_region:s c_phone:s c_mktsegment:s",
    "ddate": "d_datekey:i d_date:s d_dayofweek:s d_month:s d_year:i d_yearmonthnum:i d_yearmonth:s d_daynuminweek:i d_daynuminmonth:i d_daynuminyear:i d_monthnuminyear:i d_weeknuminyear:i d_sellingseasin:s d_lastdayinweekfl:i d_lastdayinmonthfl:i d_holidayfl:i d_weekdayfl:i",
}
# The attributes that the coded form stores as integers.
CODED = ("p_mfgr", "p_category", "p_brand1", "s_city", "s_nation", "s_region", "c_city", "c_nation", "c_region")
TABLES = tuple(_COLUMNS)


def schema(table: str, coded: bool = True) -> T.StructType:
    fields = []
    for item in _COLUMNS[table].split():
        name, kind = item.split(":")
        whole = kind == "i" or (coded and name in CODED)
        fields.append(T.StructField(name, T.IntegerType() if whole else T.StringType(), False))
    return T.StructType(fields)


def ordinals(table: str) -> dict[int, str]:
    """Column names by position, for plans and files that know positions only."""
    return dict(enumerate(f.name for f in schema(table).fields))
