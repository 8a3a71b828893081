"""Sources: Parquet directories, delimited text, and files of raw little-endian 32-bit integers."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import int32
from .schema import TABLES, ordinals, schema


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, gone at exit: below spark.checkpoint.dir, or a temporary one where the master is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(base or tempfile.gettempdir()).rstrip('/')}/asterism-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session is gone already
        if "://" not in path:
            shutil.rmtree(path, ignore_errors=True)


def parquet_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def register(spark: SparkSession, directory: str, names: Sequence[str], cache: bool = False) -> None:
    """Temporary views of the directory's tables; cache: for repeated runs over data that fits memory."""
    for name in names:
        df = parquet_table(spark, directory, name)
        (df.cache() if cache else df).createOrReplaceTempView(name)


def delimited_table(spark: SparkSession, path: str, table: str, coded: bool = True, separator: str = "|") -> DataFrame:
    """A ``.tbl`` file with a declared schema; a separator at the line's end is allowed."""
    return parse_lines(spark.read.text(path), table, coded, separator)


def parse_lines(lines: DataFrame, table: str, coded: bool = True, separator: str = "|") -> DataFrame:
    """(value) as rows of a table; a line that does not fit its schema raises."""
    kinds = schema(table, coded)
    line = F.when(F.size(F.split("value", re.escape(separator))) > len(kinds), F.regexp_replace("value", re.escape(separator) + "$", "")).otherwise(F.col("value"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
    return lines.select(F.from_csv(line, ddl, {"sep": separator, "mode": "FAILFAST"}).alias("r")).select("r.*")


def write_delimited(df: DataFrame, path: str, separator: str = "|") -> None:
    df.write.mode("overwrite").csv(path, sep=separator)


def int32_columns(spark: SparkSession, directory: str, table: str, columns: Sequence[str], rows: int = int32.ROWS) -> DataFrame:
    """Columns from headerless files ``<TABLE><position>`` of int32 values, as one table in file order.

    Only the asked columns' files are read, ranges of so many rows in parallel.
    Without columns: the rows that position 0's file has.  Files of different lengths are an error.
    """
    if table not in TABLES:
        raise ValueError(f"no table {table!r}")
    place = {name: i for i, name in ordinals(table).items()}
    wanted = list(columns) or [ordinals(table)[0]]
    paths = [f"{directory}/{table.upper()}{place[name]}" for name in wanted]
    parts = int32.ranges(paths, rows)
    # from an RDD, whose size Spark takes as unknown: a few ranges that stand for a whole table must not be broadcast
    df = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)), "first long, count long")
    df = df.mapInArrow(functools.partial(int32.read, paths, wanted), ", ".join(f"`{c}` int" for c in wanted))
    return df if columns else df.select()


def write_int32_columns(df: DataFrame, directory: str, table: str) -> None:
    """A table in that format, rows in df's order, however large: none of them passes the driver."""
    write_int32_tables({table: df}, directory)


def write_int32_tables(tables: dict[str, DataFrame], directory: str) -> None:
    """Tables in that format, rows in each one's order.

    The executors store each as Parquet in the directory, then one task for each column copies it to the
    column's file; files take their place when all of their table are whole, and the stored table goes.
    The first is copied last: executors are still removing the shuffle files of a table just stored, and
    copies beside them would take the disk of both.  Nulls and values of more than 32 bits are errors.
    """
    place = {table: {name: i for i, name in ordinals(table).items()} for table in tables}
    targets = {table: {name: f"{table.upper()}{place[table][name]}" for name in df.columns} for table, df in tables.items()}
    system, top = int32.filesystem(directory)
    system.create_dir(top)
    base = f"file://{top}" if system.type_name == "local" else directory
    stages = {table: f"{base}/.{table}-{uuid.uuid4().hex[:12]}" for table in tables}
    spark = next(iter(tables.values())).sparkSession
    try:
        for table, df in tables.items():
            _store(df, f"{stages[table]}/rows")
        for table in [*list(tables)[1:], *list(tables)[:1]]:
            _copy_columns(spark, stages[table], directory, targets[table])
            _remove(spark, stages[table])
    finally:
        for stage in stages.values():
            _remove(spark, stage)


def _copy_columns(spark: SparkSession, stage: str, directory: str, targets: dict[str, str]) -> None:
    """Columns of the table stored there to their files."""
    system, top = int32.filesystem(directory)
    copy = functools.partial(int32.copy_column, stage, int32.stored(f"{stage}/rows"))
    made = spark.sparkContext.parallelize(list(targets), len(targets)).map(copy).collect()
    if len({rows for _, _, rows in made}) > 1:
        raise ValueError(f"columns differ in length: {made}")
    for name, path, _ in made:
        if system.get_file_info(target := f"{top}/{targets[name]}").is_file:
            system.delete_file(target)
        system.move(path, target)


def _store(df: DataFrame, path: str) -> None:
    """Writes df as Parquet; its shuffle files go at once, not when the driver next collects its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(key, before)
