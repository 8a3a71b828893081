"""Result files: one line for each row, values separated by spaces, in SELECT order."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame


def result_lines(df: DataFrame) -> Iterable[str]:
    """Rows as text, fetched partition by partition."""
    for row in df.toLocalIterator():
        yield " ".join("NULL" if v is None else str(v) for v in row)


def save_result(df: DataFrame, directory: str, query: str) -> str:
    """Writes ``<first three characters of the query's name>.res`` (without a leading ``ssb_``) and gives its path."""
    path = Path(directory) / f"{query.removeprefix('ssb_')[:3]}.res"
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w") as f:
        f.writelines(f"{line}\n" for line in result_lines(df))
    return str(path)


def save_distributed(df: DataFrame, path: str) -> None:
    """The same format from the executors, one file for each partition, for results too large for one file."""
    df.write.mode("overwrite").csv(path, sep=" ", nullValue="NULL")


def print_result(df: DataFrame) -> int:
    n = 0
    for line in result_lines(df):
        print(line)
        n += 1
    print(f"Total rows in result: {n}")
    return n


def same_rows(a: Iterable[str], b: Iterable[str]) -> bool:
    """Whether two results have equal rows in any order."""
    return sorted(x.strip() for x in a if x.strip()) == sorted(x.strip() for x in b if x.strip())
