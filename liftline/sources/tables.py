"""Readers for result tables: explicit schemas, the asset from the file's name, labels and missing values made uniform."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftline.functions.expressions import no_nan, window_number


def _schema(strings: str = "", ints: str = "", doubles: str = "", order: str = "") -> T.StructType:
    kinds = dict.fromkeys(strings.split(), T.StringType()) | dict.fromkeys(ints.split(), T.IntegerType()) | dict.fromkeys(doubles.split(), T.DoubleType())
    return T.StructType([T.StructField(c, kinds[c]) for c in (order.split() if order else kinds)])


_METRICS = "pf sharpe roi trades"
MC_PERWINDOW = _schema("strategy window", "n_trades", "actual_roi actual_sharpe actual_pf roi_pct_rank sharpe_pct_rank pf_pct_rank")
WINDOW_PAIRS = T.StructType(
    [T.StructField("strategy", T.StringType()), T.StructField("window_i", T.StringType())]
    + [T.StructField(f"baseline_is_{m}", T.IntegerType() if m == "trades" else T.DoubleType()) for m in _METRICS.split()]
    + [T.StructField(f"{v}_is_pf", T.DoubleType()) for v in ("ent", "fee", "sli", "entind")]
    + [T.StructField(f"{p}_oos_{m}", T.IntegerType() if m == "trades" else T.DoubleType()) for p in ("baseline", "next_baseline") for m in _METRICS.split()]
)
BLOCK_PERM = _schema("strategy window", "n_trades", "iid_rank block2_rank block3_rank block5_rank block10_rank block20_rank")
PORTFOLIO_MC = _schema("filter", "window_i portfolio_id n_strategies n_trades", "actual_roi actual_sharpe actual_pf roi_pct_rank sharpe_pct_rank pf_pct_rank")
OVERALL = _schema("strategy", "num_windows is_opt_trades oos_opt_trades", "is_opt_sharpe is_opt_pf is_opt_roi oos_opt_sharpe oos_opt_pf oos_opt_roi")

#: suffix of <asset>_<suffix>.csv, or of block_perm_<asset>.csv: schema.
TABLES = {"mc_perwindow": MC_PERWINDOW, "window_pairs": WINDOW_PAIRS, "portfolio_mc": PORTFOLIO_MC, "overall": OVERALL, "block_perm": BLOCK_PERM}
_CSV = {"header": True, "positiveInf": "inf", "negativeInf": "-inf", "nanValue": "nan"}


def data_dir(given: str | None = None, variable: str = "LIFTLINE_DATA", default: str = ".") -> str:
    """The argument, else the environment's, else a default."""
    return given or os.environ.get(variable) or default


def _pattern(kind: str) -> tuple[str, str]:
    return ("block_perm_*.csv", r"block_perm_([^/]+)\.csv$") if kind == "block_perm" else (f"*_{kind}.csv", rf"([^/]+)_{kind}\.csv$")


def read_results(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All assets' files of a kind as one table with ``asset`` and an integer ``window_i``; NaN is null, infinities stay. Without files: an empty table of the same columns."""
    schema = TABLES[kind]
    name, asset = _pattern(kind)
    try:
        rows = spark.read.schema(schema).options(**_CSV, pathGlobFilter=name).csv(folder)
        rows = rows.withColumn("asset", F.regexp_extract(F.col("_metadata.file_path"), asset, 1))
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows = spark.createDataFrame([], schema).withColumn("asset", F.lit(None).cast("string"))
    out = rows.select("asset", *(no_nan(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in schema))
    label = "window" if "window" in schema.names else "window_i" if "window_i" in schema.names else None
    if label:
        out = out.withColumn("window_i", window_number(F.col(label)))
    return out.drop("window")


def presence(spark: SparkSession, folder: str, kind: str, assets: list[str]) -> dict[str, bool]:
    """Which assets have a file, on any file system that Spark reads."""
    name = "block_perm_{}.csv" if kind == "block_perm" else "{}_" + kind + ".csv"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    return {a: fs.exists(path(f"{folder}/{name.format(a)}")) for a in assets}


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Rank rows whose strategy names may hold commas: the leftmost ,W<number>, ends the name; lines without exactly seven more fields are dropped."""
    line = F.col("value")
    parts = spark.read.text(path).select(F.regexp_extract(line, r"^(.*?),W(\d+),(.*)$", 1).alias("name"), F.regexp_extract(line, r"^(.*?),W(\d+),(.*)$", 2).alias("w"), F.split(F.regexp_extract(line, r"^(.*?),W(\d+),(.*)$", 3), ",").alias("f"))
    rows = parts.where((F.col("w") != "") & (F.size("f") == 7))
    names = [c for c in MC_PERWINDOW.names if c not in ("strategy", "window")]
    number = lambda i, kind: no_nan(F.col("f")[i].try_cast("double")) if kind == "double" else F.col("f")[i].try_cast(kind)
    return rows.select(F.trim(F.regexp_replace("name", '"', "")).alias("strategy"), F.col("w").cast("int").alias("window_i"), *(number(i, MC_PERWINDOW[c].dataType.simpleString()).alias(c) for i, c in enumerate(names)))


def read_versioned(spark: SparkSession, folder: str, name: str, legacy_names: dict[str, str]) -> DataFrame:
    """<name>_matched.csv if it is there, else <name>.csv with its columns renamed. The label null stays a string; an empty one is that tier too."""
    options = {"header": True, "inferSchema": True, "nullValue": "\u0000"}
    try:
        rows = spark.read.options(**options).csv(f"{folder}/{name}_matched.csv")
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows = spark.read.options(**options).csv(f"{folder}/{name}.csv").withColumnsRenamed(legacy_names)
    if "tier" in rows.columns:
        rows = rows.withColumn("tier", F.coalesce(F.nullif(F.trim(F.col("tier").cast("string")), F.lit("")), F.lit("null")))
    return rows


def read_or_compute(read, compute):  # noqa: ANN001, ANN201
    """A summary that is there already, else the computation."""
    try:
        return read()
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return compute()


def read_bars(spark: SparkSession, path: str, time_column: str, series: str) -> DataFrame:
    """series, hour, close from price files: times above 1e10 are milliseconds; rows that cannot be read are dropped; an hour's last bar holds, the later line on ties."""
    rows = spark.read.option("header", True).csv(path).withColumn("line", F.monotonically_increasing_id())
    stamp: Column = F.col(time_column).try_cast("double")
    seconds = F.when(stamp > 1e10, F.floor(stamp / 1000)).otherwise(F.floor(stamp))
    fine = rows.select(seconds.alias("s"), F.col("close").try_cast("double").alias("close"), "line").where("s IS NOT NULL AND close IS NOT NULL")
    return fine.groupBy(F.lit(series).alias("series"), F.floor(F.col("s") / 3600).cast("bigint").alias("hour")).agg(F.max_by("close", F.struct("s", "line")).alias("close"))
