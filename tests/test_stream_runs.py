"""Trades from a stream equal those of the batch, with rows out of order and late ones."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from liftline.operators import sequence
from liftline.streaming import runs

HOUR = 3600


def _bars(n=60, keys=("a", "b")):
    rng = np.random.default_rng(6)
    return pd.concat([pd.DataFrame({"series": k, "t": np.arange(100, 100 + n), "position": np.repeat(rng.integers(-1, 2, n // 4 + 1), 4)[:n], "ret": np.where(rng.random(n) < 0.1, np.nan, rng.normal(0, 0.01, n))}) for k in keys])


def test_runs_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    bars = _bars()
    end = pd.DataFrame({"series": ["a", "b"], "t": 1000, "position": 0, "ret": 0.0})  # turns every open run
    last = pd.DataFrame({"series": ["z"], "t": 2000, "position": 0, "ret": 0.0})  # carries the watermark past the end
    late = pd.DataFrame({"series": ["a", "b"], "t": [101, 102], "position": 1, "ret": 9.0})  # long taken: dropped
    order = np.random.default_rng(7).permutation(len(bars))
    near = bars.iloc[order].sort_values("t", kind="stable", key=lambda t: t // 10)  # out of order within ten bars
    parts = [near[near.t < 120], near[(near.t >= 120) & (near.t < 140)], near[near.t >= 140], end, pd.concat([last, late]), pd.DataFrame({"series": ["z"], "t": 3000, "position": 0, "ret": 0.0})]
    for k, part in enumerate(parts):
        rows = spark.createDataFrame(part.astype({"t": "int64", "position": "int32"}), "series string, t bigint, position int, ret double")
        rows.select("series", F.timestamp_seconds(F.col("t") * HOUR).alias("ts"), "position", F.nanvl("ret", F.lit(None)).alias("ret")).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
        time.sleep(0.01)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("series string, ts timestamp, position int, ret double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    query = runs.trade_runs(stream, ["series"], "ts", "20 hours", cost=0.001).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["series", "run"])
    batch = sequence.trade_runs(spark.createDataFrame(bars.astype({"t": "int64"}), "series string, t bigint, position int, ret double").withColumn("ret", F.nanvl("ret", F.lit(None))), ["series"], cost=0.001).toPandas().sort_values(["series", "run"])
    assert len(batch) > 10
    for c in ("series", "run", "position", "first_t", "last_t"):
        assert got[c].tolist() == batch[c].tolist(), c
    assert np.allclose(got["pnl"], batch["pnl"])
