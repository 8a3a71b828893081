"""Files of raw little-endian 32-bit integers, one for each column, read in ranges of rows.

A task reads the same range of rows from each column's file and gives them as Arrow batches, so
columns stay side by side without a join, and files of any size are read in parallel.  The driver
looks up the files' lengths and starts no Python workers, as it would for a Python data source.  Such a file
has one writer, as most file systems ask for: a task copies one column of a stored table, batch by batch.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

WIDTH = 4
ROWS, BATCH = 4 << 20, 64 << 10

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def filesystem(path: str):
    """Of a path or URI, with the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def ranges(paths: list[str], rows: int) -> list[tuple[int, int]]:
    """First row and count of ranges of so many rows, which these files of one column each have together."""
    sizes = set()
    for path in paths:
        system, name = filesystem(path)
        size = system.get_file_info(name).size
        if size is None or size % WIDTH:
            raise ValueError(f"{path}: no file of whole 32-bit integers")
        sizes.add(size // WIDTH)
    if len(sizes) > 1:
        raise ValueError(f"column files differ in length: {sorted(sizes)}")
    n = sizes.pop()
    return [(at, min(rows, n - at)) for at in range(0, n, rows)] or [(0, 0)]


def read(paths: list[str], names: list[str], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns' values in ranges (first, count) of rows."""
    files = []
    try:
        for path in paths:
            system, name = filesystem(path)
            files.append(system.open_input_file(name))
        for part in parts:
            for first, count in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for at in range(first, first + count, BATCH):
                    n = min(BATCH, first + count - at)
                    columns = [pa.array(np.frombuffer(f.read_at(n * WIDTH, at * WIDTH), "<i4")) for f in files]
                    yield pa.RecordBatch.from_arrays(columns, names)
    finally:
        for f in files:
            f.close()


def stored(path: str) -> list[str]:
    """The files of a Parquet table that Spark wrote, in the order of their partitions."""
    from pyarrow import fs

    system, name = filesystem(path)
    found = {m: x.path for x in system.get_file_info(fs.FileSelector(name)) if (m := re.fullmatch(r"part-(\d+)-.*-c(\d+)\..*", x.base_name))}
    return [found[m] for m in sorted(found, key=lambda m: (int(m[1]), int(m[2])))]


def copy_column(directory: str, files: list[str], name: str) -> tuple[str, str, int]:
    """Copies a column of these Parquet files to a new file of int32 values; gives its name, the file's path and how many rows it has.

    A try of a task writes a file of its own, so tries that fail or that run twice leave none half written.
    """
    import pyarrow.parquet as pq

    system, top = filesystem(directory)
    path, rows = f"{top}/{name}-{uuid.uuid4().hex[:12]}", 0
    with system.open_output_stream(path) as out:
        for file in files:
            with system.open_input_file(file) as f:
                for batch in pq.ParquetFile(f).iter_batches(BATCH, columns=[name], use_threads=False):
                    values = batch.column(0)
                    if values.null_count:
                        raise ValueError(f"{name}: null is no 32-bit integer")
                    out.write(values.cast("int32").to_numpy(zero_copy_only=False).astype("<i4", copy=False).tobytes())
                    rows += len(values)
    return name, path, rows
