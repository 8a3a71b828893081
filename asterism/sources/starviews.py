"""The star: a fact table and four dimensions as views over TPC-H-like tables.

Money is whole cents, so sums are exact and do not depend on the order of
addition.  The fact view joins only those of its tables whose columns are asked
for; keys find their parents, so leaving a join out changes no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode
from ..operators.star import StarQuery
from .readers import parquet_table

#: Days that the date dimension has.
FIRST_DAY, LAST_DAY = "1970-01-01", "2069-12-31"


#: (fact column, least, most); None: open.
Bounds = Sequence[tuple[str, int | None, int | None]]


def _base_bound(column: str, low: int | None, high: int | None) -> tuple[str, Column] | None:
    """The table and a condition on its stored column that holds wherever the fact column is within the bounds; scans can prune by it."""
    if column == "lo_orderdate":
        def day(code: int) -> date | None:
            try:
                return date(code // 10000, code // 100 % 100, code % 100)
            except ValueError:  # no day of the calendar
                return None

        first, last = (None if x is None else day(x) for x in (low, high))
        limits = [F.col("o_orderdate") >= F.lit(str(first)).cast("timestamp_ntz")] if first else []
        limits += [F.col("o_orderdate") < F.lit(str(last + timedelta(days=1))).cast("timestamp_ntz")] if last else []
        table = "orders"
    elif column == "lo_quantity":  # cut to a whole number
        limits = [F.col("l_quantity") > float(low - 1)] if low is not None else []
        limits += [F.col("l_quantity") < float(high + 1)] if high is not None else []
        table = "lineitem"
    elif column == "lo_discount":  # rounded to hundredths
        limits = [F.col("l_discount") >= (low - 1) / 100] if low is not None else []
        limits += [F.col("l_discount") <= (high + 1) / 100] if high is not None else []
        table = "lineitem"
    else:
        return None
    out = None
    for x in limits:
        out = x if out is None else out & x
    return None if out is None else (table, out)


def _cents(value: str) -> Column:
    return F.round(F.expr(value) * 100).cast("bigint")


_FACT: dict[str, tuple[str, Column]] = {}


def _fact() -> dict[str, tuple[str, Column]]:
    """For each fact column the table it needs besides lineitem, and its expression."""
    if not _FACT:
        _FACT.update(
            lo_orderkey=("", F.col("l_orderkey")),
            lo_linenumber=("", F.col("l_linenumber")),
            lo_custkey=("orders", F.col("o_custkey")),
            lo_partkey=("", F.col("l_partkey")),
            lo_suppkey=("", F.col("l_suppkey")),
            lo_orderdate=("orders", encode.date_code(F.col("o_orderdate"))),
            lo_quantity=("", F.col("l_quantity").cast("int")),
            lo_extendedprice=("", _cents("l_extendedprice")),
            lo_discount=("", F.round(F.col("l_discount") * 100).cast("int")),
            lo_revenue=("", _cents("l_extendedprice * (1 - l_discount)")),
            lo_supplycost=("part", F.round(F.col("p_retailprice") * 60).cast("bigint")),
        )
    return _FACT


FACT_COLUMNS = ("lo_orderkey", "lo_linenumber", "lo_custkey", "lo_partkey", "lo_suppkey", "lo_orderdate", "lo_quantity", "lo_extendedprice", "lo_discount", "lo_revenue", "lo_supplycost")
DIMENSIONS = {"ddate": "d_datekey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}


class Star:
    """The star over one directory of tables."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def base(self, name: str) -> DataFrame:
        return parquet_table(self.spark, self.directory, name)

    def lineorder(self, columns: Iterable[str] = FACT_COLUMNS) -> DataFrame:
        return self.query(columns).frame().select(*columns)

    def query(self, columns: Iterable[str], bounds: Bounds = ()) -> StarQuery:
        """A query of the fact table: lineitem's columns first, so that dimensions on its keys filter it before it meets its parents.

        bounds: what the query's own conditions say of single columns, for the scans; they replace no condition.
        """
        wanted = list(dict.fromkeys(columns))
        unknown = [c for c in wanted if c not in FACT_COLUMNS]
        if unknown:
            raise ValueError(f"no fact columns {unknown}")
        fact = _fact()
        limits = [x for b in bounds if (x := _base_bound(*b))]

        def base(name: str) -> DataFrame:
            df = self.base(name)
            for table, limit in limits:
                df = df.where(limit) if table == name else df
            return df

        own = [c for c in wanted if not fact[c][0]]
        orders, part = ([c for c in wanted if fact[c][0] == t] for t in ("orders", "part"))
        # a key that is asked for finds the parent itself, so that shuffles carry it once
        order_key, part_key = ("lo_orderkey" if "lo_orderkey" in own else "l_orderkey"), ("lo_partkey" if "lo_partkey" in own else "l_partkey")
        keys = [k for k, needed in ((order_key, orders), (part_key, part)) if needed and k not in own]

        def late(df: DataFrame) -> DataFrame:
            if orders:
                df = df.join(base("orders").select("o_orderkey", *[fact[c][1].alias(c) for c in orders]), F.col(order_key) == F.col("o_orderkey"))
            if part:
                df = df.join(base("part").select(F.col("p_partkey").alias("l_part"), *[fact[c][1].alias(c) for c in part]), F.col(part_key) == F.col("l_part"))
            return df.drop(*keys, "o_orderkey", "l_part")

        return StarQuery(base("lineitem").select(*keys, *[fact[c][1].alias(c) for c in own]), late=late, late_columns=(*orders, *part))

    def ddate(self) -> DataFrame:
        days = self.spark.sql(f"SELECT explode(sequence(DATE'{FIRST_DAY}', DATE'{LAST_DAY}')) AS day")
        return days.select(encode.date_code(F.col("day")).alias("d_datekey"), F.year("day").alias("d_year"), (F.year("day") * 100 + F.month("day")).alias("d_yearmonthnum"), encode.yearmonth_name(F.year("day") * 100 + F.month("day")).alias("d_yearmonth"))

    def _place(self, table: str, key: str, prefix: str, columns: tuple[str, ...]) -> DataFrame:
        """The key and the asked columns; only those tables are joined that these need."""
        nation, digit = F.col(f"{prefix}_nationkey"), (F.col(key) % 10).cast("int")
        made = {
            "city": ("", (nation * 10 + digit).cast("int")),
            "nation": ("", nation),
            "region": ("nation", F.col("n_regionkey")),
            "city_name": ("nation", encode.city_name(F.col("n_name"), digit)),
            "nation_name": ("nation", F.col("n_name")),
            "region_name": ("region", F.col("r_name")),
        }
        wanted = [c.removeprefix(f"{prefix}_") for c in columns if c != key] or list(made)
        if unknown := [c for c in wanted if c not in made]:
            raise ValueError(f"no columns {unknown} in {table}")
        needs = {made[c][0] for c in wanted}
        df = self.base(table)
        if needs & {"nation", "region"}:
            df = df.join(self.base("nation"), nation == F.col("n_nationkey"))
        if "region" in needs:
            df = df.join(self.base("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return df.select(key, *[made[c][1].alias(f"{prefix}_{c}") for c in wanted])

    def customer(self, *columns: str) -> DataFrame:
        return self._place("customer", "c_custkey", "c", columns)

    def supplier(self, *columns: str) -> DataFrame:
        return self._place("supplier", "s_suppkey", "s", columns)

    def part(self) -> DataFrame:
        category = (F.substring("p_brand", 7, 10).cast("int") - 1).alias("p_category")
        df = self.base("part").select("p_partkey", category).withColumn("p_mfgr", F.floor(F.col("p_category") / 5).cast("int"))
        df = df.withColumn("p_brand1", (F.col("p_category") * 40 + (F.col("p_partkey") % 40)).cast("int"))
        return df.select("*", encode.mfgr_name(F.col("p_mfgr")).alias("p_mfgr_name"), encode.category_name(F.col("p_category")).alias("p_category_name"), encode.brand_name(F.col("p_brand1")).alias("p_brand1_name"))

    def dimension(self, name: str, *columns: str) -> DataFrame:
        """The key and the asked columns of a dimension; all of them if none are named."""
        if name not in DIMENSIONS:
            raise ValueError(f"no dimension {name!r}")
        if name in ("customer", "supplier"):
            return getattr(self, name)(*columns)
        df = getattr(self, name)()
        return df.select(*dict.fromkeys((DIMENSIONS[name], *columns))) if columns else df

    def register(self, names: Iterable[str] = ("lineorder", *DIMENSIONS)) -> None:
        """Temporary views for SQL text."""
        for name in names:
            (self.lineorder() if name == "lineorder" else self.dimension(name)).createOrReplaceTempView(name)
