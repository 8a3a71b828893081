"""A star that is computed once and stored: the form to query again and again at scale.

The fact table is dealt by ranges of the order date and sorted by it, so a
predicate on the date skips files and row groups by their statistics; its parent
tables are joined at that time and never again.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode
from .readers import delimited_table, int32_columns, write_delimited, write_int32_tables
from .schema import CODED, schema
from ..operators.star import StarQuery
from .starviews import DIMENSIONS, FACT_COLUMNS, Bounds, Star

#: Rows of a file of the stored fact table: about 100 MB.
FILE_ROWS = 5_000_000


def save_star(star: Star, path: str) -> SavedStar:
    """Writes all tables of a star; the fact table in files of about FILE_ROWS rows each."""
    fact = star.lineorder()
    files = -(-star.lineorder(["lo_orderkey"]).count() // FILE_ROWS) or 1
    fact.repartitionByRange(max(files, star.spark.sparkContext.defaultParallelism), "lo_orderdate", "lo_orderkey").sortWithinPartitions("lo_orderdate").write.mode("overwrite").parquet(f"{path}/lineorder")
    for name in DIMENSIONS:
        df = star.dimension(name)
        if name == "ddate":  # only the days between the fact table's first and last
            first, last = star.spark.read.parquet(f"{path}/lineorder").agg(F.min("lo_orderdate"), F.max("lo_orderdate")).first()
            df = df.where(F.col("d_datekey").between(first, last))
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return SavedStar(star.spark, path)


class SavedStar(Star):
    """The star in a directory that save_star() wrote."""

    def __init__(self, spark: SparkSession, directory: str):
        super().__init__(spark, directory)
        self._schemas: dict = {}

    def _table(self, name: str) -> DataFrame:
        path = f"{self.directory}/{name}"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def lineorder(self, columns: Iterable[str] = FACT_COLUMNS) -> DataFrame:
        return self._table("lineorder").select(*columns)

    def query(self, columns: Iterable[str], bounds: Bounds = ()) -> StarQuery:
        """The fact table as it is stored; its own conditions are pushed down as they stand."""
        return StarQuery(self.lineorder(columns))

    def ddate(self) -> DataFrame:
        return self._table("ddate")

    def part(self) -> DataFrame:
        return self._table("part")

    def customer(self, *columns: str) -> DataFrame:
        df = self._table("customer")
        return df.select(*dict.fromkeys(("c_custkey", *columns))) if columns else df

    def supplier(self, *columns: str) -> DataFrame:
        df = self._table("supplier")
        return df.select(*dict.fromkeys(("s_suppkey", *columns))) if columns else df


class FileStar(SavedStar):
    """The star in the benchmark's own files: ``<TABLE><position>`` columns of int32 values, or ``<table>.tbl`` text, coded or with strings.

    Coded files have integers for places, makers, categories and brands; files with strings have
    their names, from which makers', categories' and brands' codes are found.
    """

    def __init__(self, spark: SparkSession, directory: str, form: str = "int32"):
        if form not in ("int32", "coded", "strings"):
            raise ValueError(f"no form {form!r}")
        super().__init__(spark, directory)
        self.form = form

    def _table(self, name: str) -> DataFrame:
        if self.form == "int32":
            return int32_columns(self.spark, self.directory, name, [c for c in USED[name] if not c.endswith("_name")])
        df = delimited_table(self.spark, f"{self.directory}/{name}.tbl", name, coded=self.form == "coded")
        held = [c for c in USED[name] if c in df.columns]
        return df.select(*[F.col(c).alias(f"{c}_name") if self.form == "strings" and c in CODED else F.col(c) for c in held])

    def lineorder(self, columns: Iterable[str] = FACT_COLUMNS) -> DataFrame:
        if self.form == "int32":
            return int32_columns(self.spark, self.directory, "lineorder", list(columns))
        return super().lineorder(columns)

    def ddate(self) -> DataFrame:
        return self._table("ddate").withColumn("d_yearmonth", encode.yearmonth_name(F.col("d_yearmonthnum")))

    def part(self) -> DataFrame:
        df = self._table("part")
        made = {"p_mfgr": encode.mfgr_code, "p_category": encode.category_code, "p_brand1": encode.brand_code}
        named = {"p_mfgr": encode.mfgr_name, "p_category": encode.category_name, "p_brand1": encode.brand_name}
        if self.form == "strings":
            return df.select("*", *[f(F.col(f"{c}_name")).alias(c) for c, f in made.items()])
        return df.select("*", *[f(F.col(c)).alias(f"{c}_name") for c, f in named.items()])


# The columns of each table that the queries need.
USED = {
    "lineorder": FACT_COLUMNS,
    "ddate": ("d_datekey", "d_year", "d_yearmonthnum"),
    "customer": ("c_custkey", "c_city", "c_nation", "c_region"),
    "supplier": ("s_suppkey", "s_city", "s_nation", "s_region"),
    "part": ("p_partkey", "p_mfgr", "p_category", "p_brand1"),
}


def _fact_int32(star: Star, columns: Iterable[str]) -> DataFrame:
    """The fact table as int columns.  On their way through the joins two of lineitem's own columns are one number, so that shuffles carry fewer."""
    query = star.query(columns)
    own = [c for c in query.fact.columns if c.startswith("lo_") and c not in ("lo_orderkey", "lo_partkey")]
    pairs = [(f"_{i}", *own[i : i + 2]) for i in range(0, len(own) - 1, 2)]
    paired = {c for _, *two in pairs for c in two}

    def number(c: str) -> Column:
        return F.col(c).cast("int").cast("bigint")

    both = [F.shiftleft(number(a), 32).bitwiseOR(number(b).bitwiseAND(F.lit(0xFFFFFFFF))).alias(name) for name, a, b in pairs]
    held = {a: F.shiftright(name, 32) for name, a, _ in pairs} | {b: F.shiftright(F.shiftleft(name, 32), 32) for name, _, b in pairs}
    fact = query.fact.select(*[c for c in query.fact.columns if c not in paired], *both)
    return replace(query, fact=fact).frame().select(*[held.get(c, F.col(c)).cast("int").alias(c) for c in columns])


def export_star(star: Star, directory: str, form: str = "int32") -> FileStar:
    """Writes a star in the benchmark's own files; columns that no query needs hold 0 or ``-`` as text and are left out as int32."""
    if form == "int32":
        write_int32_tables({name: _fact_int32(star, used) if name == "lineorder" else star.dimension(name).select(*[F.col(c).cast("int") for c in used]) for name, used in USED.items()}, directory)
        return FileStar(star.spark, directory, form)
    for name, used in USED.items():
        df = star.lineorder(used) if name == "lineorder" else star.dimension(name)
        kinds = schema(name, coded=form == "coded")

        def value(f):
            held = f"{f.name}_name" if form == "strings" and f.name in CODED else f.name
            if f.name in used and held in df.columns:
                return F.col(held).cast(f.dataType).alias(f.name)
            return F.lit(0 if f.dataType.typeName() == "integer" else "-").alias(f.name)

        write_delimited(df.select(*[value(f) for f in kinds.fields]), f"{directory}/{name}.tbl")
    return FileStar(star.spark, directory, form)
