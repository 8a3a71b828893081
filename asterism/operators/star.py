"""Star queries: a fact table, dimensions with their filters, one grouped sum or count, an order.

A dimension that gives no column to the result only filters: it becomes a left
semi join, which is right whatever its keys.  One that gives columns becomes an
inner join on its key.  Whether a side is broadcast is left to Catalyst and to
adaptive execution, which know sizes; nothing here hints.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dimension:
    table: DataFrame
    key: str
    fact_key: str
    where: Column | None = None
    columns: tuple[str, ...] = ()

    @property
    def kind(self) -> str:
        return "inner" if self.columns else "left_semi"


@dataclass(frozen=True)
class StarQuery:
    fact: DataFrame
    condition: Column | None = None
    dimensions: tuple[Dimension, ...] = ()
    group: tuple[str, ...] = ()
    measures: tuple[Column, ...] = ()
    output: tuple[str, ...] = ()
    order: tuple[Column, ...] = field(default=())
    #: Adds further columns to the fact table, by joins with its parents, and the names of these.
    late: Callable[[DataFrame], DataFrame] | None = None
    late_columns: tuple[str, ...] = ()

    def where(self, condition: Column) -> StarQuery:
        return replace(self, condition=condition if self.condition is None else self.condition & condition)

    def dimension(self, table: DataFrame, key: str, fact_key: str, where: Column | None = None, columns: Sequence[str] = ()) -> StarQuery:
        return replace(self, dimensions=(*self.dimensions, Dimension(table, key, fact_key, where, tuple(columns))))

    def aggregate(self, *measures: Column, by: Sequence[str] = ()) -> StarQuery:
        return replace(self, measures=measures, group=tuple(by))

    def select(self, *names: str) -> StarQuery:
        return replace(self, output=names)

    def order_by(self, *columns: Column | str) -> StarQuery:
        return replace(self, order=tuple(F.col(c) if isinstance(c, str) else c for c in columns))

    def frame(self) -> DataFrame:
        """The query as a DataFrame.

        Dimensions on the fact table's own keys come first, those that only filter before
        those that add columns; then its parents are joined, then come the dimensions on
        keys that these have brought.
        """

        def joined(df: DataFrame, late: bool) -> DataFrame:
            for d in sorted(self.dimensions, key=lambda d: bool(d.columns)):
                if (d.fact_key in self.late_columns) == late:
                    side = d.table if d.where is None else d.table.where(d.where)
                    df = df.join(side.select(F.col(d.key), *d.columns), F.col(d.fact_key) == F.col(d.key), d.kind)
            return df

        df = joined(self.fact, False) if self.late else self.fact
        if self.late:
            df = self.late(df)
        if self.condition is not None:
            df = df.where(self.condition)
        df = joined(df, True) if self.late else joined(df, False)
        if self.measures:
            df = df.groupBy(*self.group).agg(*self.measures) if self.group else df.agg(*self.measures)
        if self.output:
            df = df.select(*self.output)
        return df.orderBy(*self.order) if self.order else df

