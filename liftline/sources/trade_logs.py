"""Binary trade logs: <base>/<family>/<strategy>/trades.bin, decoded where the files are read."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.session import ship

#: Entry bar, exit bar, direction, result; little-endian, packed.
_TRADE = np.dtype([("entry", "<u4"), ("exit", "<u4"), ("dir", "u1"), ("pnl", "<f8")])


def sections(data: bytes) -> Iterator[tuple[str, str, np.ndarray]]:
    """(lookback, section, trades) until the data end. A name of length 0 ends them too; of a section that is cut off the whole trades are kept."""
    at = 0

    def text() -> str | None:
        nonlocal at
        if at + 2 > len(data):
            return None
        (n,) = struct.unpack_from("<H", data, at)
        at += 2
        if at + n > len(data):
            return None
        value = data[at : at + n].decode("utf-8", "replace")
        at += n
        return value

    while name := text():
        lookback, section = text(), text()
        if lookback is None or section is None or at + 4 > len(data):
            return
        (count,) = struct.unpack_from("<I", data, at)
        at += 4
        whole = min(count, (len(data) - at) // _TRADE.itemsize)
        yield lookback, section, np.frombuffer(data, _TRADE, whole, at)
        at += whole * _TRADE.itemsize
        if whole < count:
            return


def read_trades(spark: SparkSession, base: str) -> DataFrame:
    """family, strategy, lookback, section, i, entry, exit, dir (1 or -1), pnl."""
    ship(spark)
    try:
        files = spark.read.format("binaryFile").load(f"{base}/*/*/trades.bin")
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        files = spark.createDataFrame([], "path string, content binary")
    place = r"/([^/]+)/([^/]+)/trades\.bin$"
    files = files.select(F.regexp_extract("path", place, 1).alias("family"), F.regexp_extract("path", place, 2).alias("strategy"), "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for family, strategy, content in batch.itertuples(index=False):
                for lookback, section, trades in sections(bytes(content)):
                    more = {"i": np.arange(len(trades), dtype=np.int32), "entry": trades["entry"].astype(np.int64), "exit": trades["exit"].astype(np.int64), "dir": np.where(trades["dir"] == 1, 1, -1).astype(np.int32), "pnl": trades["pnl"].astype(np.float64)}
                    yield pd.DataFrame({"family": family, "strategy": strategy, "lookback": lookback, "section": section, **more})

    return files.mapInPandas(decode, "family string, strategy string, lookback string, section string, i int, entry bigint, exit bigint, dir int, pnl double")


def in_sample(trades: DataFrame, min_trades: int = 10) -> DataFrame:
    """family, strategy, window_i, pnls: sections W<n>-IS, case as given, with enough trades."""
    window = F.regexp_extract("section", r"^W(\d+)-IS$", 1)
    rows = trades.withColumn("window_i", F.nullif(window, F.lit("")).cast("int")).where("window_i IS NOT NULL")
    packed = rows.groupBy("family", "strategy", "window_i", "lookback").agg(F.array_sort(F.collect_list(F.struct("i", "pnl"))).alias("t"))
    return packed.where(F.size("t") >= min_trades).select("family", "strategy", "window_i", F.transform("t", lambda x: x["pnl"]).alias("pnls"))


def held_positions(trades: DataFrame, window_size: int = 5000, oos_only: bool = False) -> DataFrame:
    """family, strategy, bar, dir: bars from entry to exit, both included, shifted by the window; the last trade holds on overlaps."""
    rows = trades.withColumn("window_i", F.nullif(F.regexp_extract("section", r"^W(\d+)-", 1), F.lit("")).cast("int")).where("window_i IS NOT NULL")
    if oos_only:
        rows = rows.where(F.lower("section").endswith("-oos"))
    shift = (F.col("window_i") - 1) * window_size
    bars = rows.where("entry <= exit").withColumn("bar", F.explode(F.sequence(F.col("entry") + shift, F.col("exit") + shift)))
    return bars.groupBy("family", "strategy", "bar").agg(F.max_by("dir", F.struct("window_i", "section", "i")).alias("dir"))


def write_log(path: str, parts: list[tuple[str, str, str, list[tuple[int, int, int, float]]]]) -> None:
    """A log of (name, lookback, section, trades), for fixtures."""
    with open(path, "wb") as f:
        for name, lookback, section, trades in parts:
            for x in (name, lookback, section):
                raw = x.encode("utf-8")
                f.write(struct.pack("<H", len(raw)) + raw)
            f.write(struct.pack("<I", len(trades)) + np.array([tuple(t) for t in trades], _TRADE).tobytes())
