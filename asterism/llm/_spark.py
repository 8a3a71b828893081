"""Spark plumbing that the operators share: written intermediate tables, sizes, connected components."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python: texts can be long, so few.
BATCH_ROWS = 500
_root: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This run's folder below spark.checkpoint.dir; below a temporary folder only where that is unset and the master local (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _root:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base or tempfile.mkdtemp(prefix="checkpoints-")
        _root[app] = f"{base.rstrip('/')}/work-{uuid.uuid4().hex[:12]}"
        atexit.register(_clean, spark, _root[app])
    return _root[app]


def _clean(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session is gone already
        pass


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, with its path: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _ship(spark: SparkSession) -> None:
    """Sends this package to the executors once; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    d = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    with zipfile.ZipFile(path := f"{d}/{top.name}.zip", "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def small_batches(df: DataFrame) -> None:
    """Readies the session for Python operators: this package on the executors, and bounded Arrow batches (a smaller setting stays)."""
    _ship(df.sparkSession)
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Partitions of one exchange at most: with more the driver's bookkeeping (maps x partitions) outweighs the gain.
MOST_PARTITIONS = 20_000


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken, in any case of letters."""
    held = {x.lower() for x in taken}
    while name.lower() in held:
        name += "_"
    return name


def stored_bytes(df: DataFrame) -> int:
    """About the bytes of df's sources as stored; if one does not know its size, half of the bytes of the strings, by one pass over them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if max(sizes, default=0) < 1 << 55:
        return sum(sizes)
    strings = [F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) for name, kind in df.dtypes if kind == "string"]
    return int(df.agg(F.sum(sum(strings, F.lit(0)))).first()[0] or 0) // 2 if strings else 0


def slices(df: DataFrame, mb: int = 12) -> int:
    """How many cells of about mb MB of stored input df has, however many that are; the session's shuffle partitions at least.

    A cell bounds what is in memory at once.  partitions() of them are dealt; a task streams its cells one by one.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored_bytes(df) // (mb << 20))


def partitions(cells: int) -> int:
    return min(cells, MOST_PARTITIONS)


def by_cells(df: DataFrame, cells: int, *order: str) -> DataFrame:
    """Rows dealt by ``cell``, a number below cells: each partition has a run of cells, as many as the others, sorted by cell and order."""
    n = partitions(cells)
    return df.repartitionById(n, F.expr(f"cast((cast(cell AS bigint) * {n}L) div {cells}L AS int)")).sortWithinPartitions("cell", *order)


def gathered(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.Table]:
    """Tables of about limit bytes of the column each; one row can be more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        own = col.nbytes
        step = max(1, int(batch.num_rows * limit / max(own, limit)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += own * part.num_rows // batch.num_rows
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def release() -> None:
    """Gives memory that is free back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(f):
    """f for mapInArrow(); free memory goes back at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], limit: int) -> Iterator[tuple[tuple, pa.Table, bool]]:
    """Rows that come sorted by keys, as (key, table, whole) in pieces of about limit bytes; whole: the table is all that the key has."""
    held: list[pa.RecordBatch] = []
    size, last, first = 0, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        at = 0
        for end in range(1, batch.num_rows + 1):
            if end < batch.num_rows and all(c[end] == c[at] for c in columns):
                continue
            key = tuple(c[at] for c in columns)
            if held and key != last:
                yield last, pa.Table.from_batches(held), first
                held, size, first = [], 0, True
            elif key != last:
                first = True
            last = key
            part = batch.slice(at, end - at)
            each = max(1, int(part.num_rows * limit / max(part.nbytes, limit)))
            for k in range(0, part.num_rows, each):
                if size >= limit:
                    yield last, pa.Table.from_batches(held), False
                    held, size, first = [], 0, False
                held.append(part.slice(k, each))
                size += held[-1].nbytes
            at = end
    if held:
        yield last, pa.Table.from_batches(held), first


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for each node that has an edge.

    Alternating stars: every node hangs its larger neighbours, then its smaller
    ones, on its smallest neighbour, until nothing changes.  The number of rounds grows with the logarithm of the longest path.
    Each round ends in a written table; nothing is collected.

    rounds: after so many, each node gets the smallest node that it hangs on by then.  Nodes
    with one such are connected; those with different ones may be as well.
    """
    spark = edges.sparkSession
    pairs, path = written(edges.where("a != b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct(), "edges")
    before, done = None, 0
    while done != rounds:
        # large star: neighbours above a node go to the node's smallest neighbour
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        # small star: edges now point down; a node's smaller neighbours and itself go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(low.select("a", F.col("m").alias("b"))).distinct()
        new, new_path = written(small, "edges")
        done += 1
        stat = None if done == rounds else new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        remove(spark, path)
        pairs, path = new, new_path
        if stat and (stat == before or not stat["n"]):
            break
        before = stat
    out = pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())
    return out if rounds is None else out.groupBy("node").agg(F.min("component").alias("component"))
