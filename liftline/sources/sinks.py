"""Writers for result tables. Numbers are formatted here and nowhere before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", single: bool = False) -> None:
    """CSV with a header, missing values empty, infinities as inf. ``single`` writes one file and is for summary tables only."""
    (df.coalesce(1) if single else df).write.mode(mode).options(header=True, emptyValue="").csv(path)


def fixed(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """Columns as strings of so many places."""
    return df.withColumns({c: F.format_string(f"%.{n}f", F.col(c).cast("double")) for c, n in places.items()})


def write_fixed(df: DataFrame, path: str, places: dict[str, int], mode: str = "errorifexists") -> None:
    """Fixed precision, every field in quotes, so that names may hold commas."""
    fixed(df, places).write.mode(mode).options(header=True, quoteAll=True, escape='"').csv(path)


def write_matrix(df: DataFrame, row: str, column: str, value: str, labels: list, path: str, mode: str = "errorifexists") -> None:
    """A wide matrix with the given columns, 0 where a cell is missing."""
    wide = df.groupBy(row).pivot(column, labels).agg(F.first(value)).na.fill(0.0)
    write_table(wide.orderBy(row), path, mode, single=True)


def write_versioned(df: DataFrame, path: str) -> str:
    """Beside what is there, never over it: the path with the first free number."""
    fs = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    n, target = 0, path
    while fs.exists(df.sparkSession._jvm.org.apache.hadoop.fs.Path(target)):
        n += 1
        target = f"{path}.v{n}"
    write_table(df, target)
    return target
