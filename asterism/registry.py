"""Named queries over the driver's tables, and the DuckDB SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, queries as star_queries, sql_texts
from .functions import encode
from .functions.arith import operate
from .functions.predicates import Range, compare, logical, search
from .operators.star import StarQuery
from .plans import examples
from .plans.compile import compile_plan
from .plans.usage import semi_joins
from .sources.readers import delimited_table, scratch, write_delimited
from .sources.saved import FileStar, export_star
from .sources.schema import schema
from .sources.starviews import Star

C = F.col
Query = Callable[[SparkSession, str], DataFrame]
KEYS = ["lo_orderkey", "lo_linenumber"]


def run_plan(spark: SparkSession, sf_dir: str, plan) -> DataFrame:
    star = Star(spark, sf_dir)

    def table(name: str, columns: list[str]) -> DataFrame:
        return star.lineorder(columns) if name == "lineorder" else star.dimension(name, *columns).select(*columns)

    return compile_plan(semi_joins(plan, examples.UNIQUE), table)


def run_sql(spark: SparkSession, sf_dir: str, text: str, form: str | None = None) -> DataFrame:
    """SQL text over the star views, in a session of its own, so that the caller's views stay as they are."""
    own = spark.newSession()
    (FileStar(own, sf_dir, form) if form else Star(own, sf_dir)).register()
    return own.sql(text)


def run_files(spark: SparkSession, directory: str, form: str, name: str) -> DataFrame:
    """A benchmark query, as q21 or ssb_q21, over a directory of the benchmark's own files."""
    return (star_queries.STRINGS if form == "strings" else star_queries.CODED)[name.removeprefix("ssb_").removeprefix("str_")](FileStar(spark, directory, form))


def _fact(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return Star(spark, sf_dir).lineorder([*KEYS, *columns])


def _filtered(condition: Callable[[], "F.Column"], *columns: str) -> Query:
    return lambda spark, d: _fact(spark, d, *columns).where(condition()).select(*KEYS)


def _by(*keys: str, day: bool = True, order: bool = False) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        star = Star(spark, d)
        q = StarQuery(star.lineorder(["lo_orderdate", "lo_discount", "lo_quantity", "lo_revenue"]))
        if day:
            q = q.dimension(star.ddate(), "d_datekey", "lo_orderdate", None, ["d_year"])
        q = q.aggregate(F.sum("lo_revenue").cast("bigint").alias("revenue"), by=keys)
        return (q.order_by(C("d_year").asc(), C("revenue").desc()) if order else q).frame()

    return run


def _join_star_mixed(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    q = StarQuery(star.lineorder([*KEYS, "lo_custkey", "lo_suppkey", "lo_orderdate"])).dimension(star.customer("c_region", "c_nation"), "c_custkey", "lo_custkey", C("c_region") == 2, ["c_nation"])
    q = q.dimension(star.ddate(), "d_datekey", "lo_orderdate", None, ["d_year"]).dimension(star.supplier("s_region"), "s_suppkey", "lo_suppkey", C("s_region") == 3)
    return q.select(*KEYS, "d_year", "c_nation").frame()


def _days(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return star.ddate().join(star.base("orders").select(encode.date_code(C("o_orderdate")).alias("day")), C("d_datekey") == C("day"), "left_semi")


def _roundtrip(spark: SparkSession, d: str) -> DataFrame:
    name = C("p_brand1_name")
    return Star(spark, d).part().select("p_partkey", encode.mfgr_code(name).alias("p_mfgr"), encode.category_code(name).alias("p_category"), encode.brand_code(name).alias("p_brand1"), encode.brand_name(encode.brand_code(name)).alias("p_brand1_name"))


def _files(spark: SparkSession, d: str, form: str) -> FileStar:
    """The star written in one of the benchmark's own file forms, to be read back."""
    return export_star(Star(spark, d), scratch(spark, form), form)


def _delimited(spark: SparkSession, d: str) -> DataFrame:
    """The fact table as lines of delimited text in files, and what the reader makes of them."""
    kinds = schema("lineorder")
    fact = Star(spark, d).lineorder()
    rows = fact.select(*[(C(f.name) if f.name in fact.columns else F.lit("-" if f.dataType.typeName() == "string" else 0)).cast(f.dataType).alias(f.name) for f in kinds.fields])
    write_delimited(rows, path := f"{scratch(spark, 'delimited')}/lineorder.tbl")
    return delimited_table(spark, path, "lineorder").select("lo_orderkey", "lo_linenumber", "lo_custkey", "lo_orderpriority", "lo_quantity", "lo_revenue")


SINGLE: dict[str, Query] = {
    "scan_prune": lambda s, d: Star(s, d).base("lineitem").select("l_orderkey", C("l_quantity").cast("int").alias("quantity")),
    "scan_star": lambda s, d: Star(s, d).lineorder(),
    "dim_ddate": _days,
    "dim_customer": lambda s, d: Star(s, d).customer(),
    "dim_supplier": lambda s, d: Star(s, d).supplier(),
    "dim_part": lambda s, d: Star(s, d).part(),
    "filter_cmp_lit": lambda s, d: Star(s, d).base("lineitem").where(compare(">=", C("l_quantity"), 45)).select("l_orderkey", "l_linenumber"),
    "filter_cmp_col": _filtered(lambda: compare(">", C("lo_supplycost"), C("lo_extendedprice")), "lo_supplycost", "lo_extendedprice"),
    "filter_and": _filtered(lambda: logical("AND", [compare("<", C("lo_quantity"), 5), compare("<>", C("lo_discount"), 4), compare(">", C("lo_orderdate"), 19970000)]), "lo_quantity", "lo_discount", "lo_orderdate"),
    "filter_or": _filtered(lambda: logical("OR", [compare("<=", C("lo_quantity"), 2), compare("==", C("lo_discount"), 10)]), "lo_quantity", "lo_discount"),
    "filter_nested": _filtered(
        lambda: logical("AND", [logical("OR", [compare("<", C("lo_quantity"), 3), compare("=", C("lo_discount"), 10)]), logical("OR", [compare("<", C("lo_orderdate"), 19960101), compare(">=", C("lo_orderdate"), 20000101)])]),
        "lo_quantity", "lo_discount", "lo_orderdate",
    ),
    "filter_lit_first": lambda s, d: Star(s, d).base("lineitem").where(compare(">=", 3, C("l_quantity"))).select("l_orderkey", "l_linenumber"),
    "search_range": _filtered(lambda: search(C("lo_discount"), [Range(4, 6)]), "lo_discount"),
    "search_points": _filtered(lambda: search(C("lo_quantity"), [Range(1, 1), Range(7, 7), Range(49, 49)]), "lo_quantity"),
    "search_mixed": _filtered(lambda: search(C("lo_quantity"), [Range(3, 3), Range(5, 5), Range(20, 23, False, False), Range(49, None)]), "lo_quantity"),
    "flag_count": lambda s, d: _fact(s, d, "lo_discount", "lo_quantity").where(C("lo_discount").between(1, 3) & (C("lo_quantity") < 25)).agg(F.count(F.lit(1)).alias("survivors")),
    "join_semi": lambda s, d: StarQuery(_fact(s, d, "lo_suppkey")).dimension(Star(s, d).supplier("s_region"), "s_suppkey", "lo_suppkey", C("s_region") == 1).select(*KEYS).frame(),
    "join_lookup": lambda s, d: StarQuery(_fact(s, d, "lo_partkey")).dimension(Star(s, d).part(), "p_partkey", "lo_partkey", C("p_category") == 1, ["p_brand1"]).select(*KEYS, "p_brand1").frame(),
    "join_star_mixed": _join_star_mixed,
    "project_ref": lambda s, d: Star(s, d).lineorder(["lo_revenue", "lo_orderkey"]),
    "project_lit": lambda s, d: Star(s, d).base("lineitem").select("l_orderkey", "l_linenumber", F.lit(7).alias("seven")),
    "project_colcol": lambda s, d: _fact(s, d, "lo_extendedprice", "lo_discount", "lo_revenue", "lo_supplycost").select(*KEYS, operate("*", C("lo_extendedprice"), C("lo_discount")).alias("product"), operate("-", C("lo_revenue"), C("lo_supplycost")).alias("profit"), operate("+", C("lo_revenue"), C("lo_supplycost")).alias("total")),
    "project_litcol": lambda s, d: _fact(s, d, "lo_discount").select(*KEYS, operate("-", 100, C("lo_discount")).alias("rest")),
    "project_collit": lambda s, d: _fact(s, d, "lo_quantity").select(*KEYS, operate("*", C("lo_quantity"), 3).alias("thrice")),
    "project_div": lambda s, d: _fact(s, d, "lo_extendedprice").select(*KEYS, operate("/", C("lo_extendedprice"), 100).alias("units")),
    "agg_sum": lambda s, d: Star(s, d).lineorder(["lo_revenue"]).agg(F.sum("lo_revenue").cast("bigint").alias("revenue")),
    "agg_sum_empty": lambda s, d: Star(s, d).lineorder(["lo_revenue", "lo_quantity"]).where("lo_quantity > 1000").agg(F.sum("lo_revenue").cast("bigint").alias("revenue")),
    "agg_sum_zero": lambda s, d: Star(s, d).lineorder(["lo_revenue", "lo_quantity"]).where("lo_quantity > 1000").agg(F.coalesce(F.sum("lo_revenue"), F.lit(0)).cast("bigint").alias("revenue")),
    "agg_group1": _by("lo_discount", day=False),
    "agg_group2": _by("d_year", "lo_discount"),
    "agg_group3": _by("d_year", "lo_discount", "lo_quantity"),
    "agg_count": lambda s, d: Star(s, d).lineorder(["lo_discount"]).groupBy("lo_discount").agg(F.count(F.lit(1)).alias("n")),
    "agg_minmax": lambda s, d: Star(s, d).lineorder(["lo_revenue", "lo_orderdate"]).agg(F.min("lo_revenue").alias("least"), F.max("lo_revenue").alias("most"), F.min("lo_orderdate").alias("first_day"), F.max("lo_orderdate").alias("last_day")),
    "sort_multi": _by("d_year", "lo_discount", order=True),
    "encode_roundtrip": _roundtrip,
    "delimited_table": _delimited,
    "int32_columns": lambda s, d: _files(s, d, "int32").lineorder(),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"ssb_{k}": lambda s, d, f=f: f(Star(s, d)) for k, f in star_queries.CODED.items()}
    out |= {f"ssb_str_{k}": lambda s, d, f=f: f(Star(s, d)) for k, f in star_queries.STRINGS.items()}
    out |= {f"plan_ir_{k}": lambda s, d, f=f: run_plan(s, d, f()) for k, f in examples.PLANS.items()}
    out |= {f"sql_{k}": lambda s, d, t=t: run_sql(s, d, t) for k, t in sql_texts.TEXTS.items()}
    forms = {"int32": ("q11", "q21", "q31", "q41"), "coded": ("q12", "q22"), "strings": ("q12", "q22", "q31")}
    for form, names in forms.items():
        source = star_queries.STRINGS if form == "strings" else star_queries.CODED
        out |= {f"files_{form}_{k}": lambda s, d, f=source[k], form=form: f(_files(s, d, form)) for k in names}
    return out | SINGLE


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
