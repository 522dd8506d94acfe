import os
import time

import pytest
from pyspark.sql import functions as F

from liftline.sources import sinks, tables, trade_logs
from liftline.streaming import counts


def test_results_with_labels_and_missing_values(spark, tmp_path):
    (tmp_path / "btc_mc_perwindow.csv").write_text('strategy,window,n_trades,actual_roi,actual_sharpe,actual_pf,roi_pct_rank,sharpe_pct_rank,pf_pct_rank\n"A,(1;2)",W03,20,1.5,nan,inf,50,75,90\nB,4,10,-inf,0,1,,0,100\n')
    rows = {r.strategy: r for r in tables.read_results(spark, str(tmp_path), "mc_perwindow").collect()}
    assert rows["A,(1;2)"].window_i == 3 and rows["B"].window_i == 4
    assert rows["A,(1;2)"].actual_sharpe is None and rows["A,(1;2)"].actual_pf == float("inf")
    assert rows["B"].roi_pct_rank is None and rows["B"].asset == "btc"
    assert tables.presence(spark, str(tmp_path), "mc_perwindow", ["btc", "sol"]) == {"btc": True, "sol": False}


def test_missing_files_are_an_empty_table(spark, tmp_path):
    gone = tables.read_results(spark, str(tmp_path / "none"), "window_pairs")
    assert gone.count() == 0 and "asset" in gone.columns and "window_i" in gone.columns


def test_tolerant_lines(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('strategy,window,rest\n"M,A(1,2)",W07,30,1,2,3,4,5,6\nbad,W01,1,2\nplain,W02,9,1,1,1,1,1,nan\n')
    rows = {r.strategy: r for r in tables.read_tolerant(spark, str(f)).collect()}
    assert set(rows) == {"M,A(1,2)", "plain"}
    assert rows["M,A(1,2)"].window_i == 7 and rows["M,A(1,2)"].n_trades == 30 and rows["plain"].pf_pct_rank is None


def test_versions(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Filter,tier\nx,\ny,edge\n")
    old = tables.read_versioned(spark, str(tmp_path), "s", {"Filter": "filter"})
    assert {(r["filter"], r.tier) for r in old.collect()} == {("x", "null"), ("y", "edge")}
    (tmp_path / "s_matched.csv").write_text("filter,tier\nz,null\n")
    assert [(r["filter"], r.tier) for r in tables.read_versioned(spark, str(tmp_path), "s", {}).collect()] == [("z", "null")]
    assert tables.read_or_compute(lambda: spark.read.csv(str(tmp_path / "no")), lambda: 5) == 5


def test_bars(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("time,close\n1700000000,1\n1700000000000,2\nxx,3\n1700003700,4\n1700003600,5\n")
    out = {r.hour: r.close for r in tables.read_bars(spark, str(f), "time", "a").collect()}
    assert out == {1700000000 // 3600: 2.0, 1700003700 // 3600: 4.0}


def test_trade_logs(spark, tmp_path):
    d = tmp_path / "RSI" / "s1"
    d.mkdir(parents=True)
    t = lambda n, d=1: [(k * 2, k * 2 + 3, d, float(k)) for k in range(n)]
    path = str(d / "trades.bin")
    trade_logs.write_log(path, [("s", "5", "W03-IS", t(10)), ("s", "5", "W04-IS", t(9)), ("s", "5", "W03-is", t(12)), ("s", "5", "W03-oos", t(2, 0)), ("s", "5", "W05-OOS", t(2, 2))])
    rows = trade_logs.read_trades(spark, str(tmp_path))
    assert rows.count() == 35 and {(r.family, r.strategy) for r in rows.select("family", "strategy").distinct().collect()} == {("RSI", "s1")}
    kept = trade_logs.in_sample(rows).collect()
    assert [(r.window_i, r.pnls) for r in kept] == [(3, [float(k) for k in range(10)])]
    bars = trade_logs.held_positions(rows, 100, oos_only=True).collect()
    assert {b.dir for b in bars} == {-1} and min(b.bar for b in bars) == 200 and max(b.bar for b in bars) == 405
    for other in (tmp_path / "trades.bin", tmp_path / "RSI" / "trades.bin", d / "deep" / "trades.bin"):  # not at the depth of logs
        other.parent.mkdir(exist_ok=True)
        trade_logs.write_log(str(other), [("s", "5", "W03-IS", t(3))])
    assert trade_logs.read_trades(spark, str(tmp_path)).count() == 35 and trade_logs.read_trades(spark, str(tmp_path / "none")).count() == 0
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[:-5])
    assert trade_logs.read_trades(spark, str(tmp_path)).count() == 34


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1.005, 1), ('q"', -2.0, 2)], "strategy string, x double, k int")
    sinks.write_fixed(df.coalesce(1), str(tmp_path / "f"), {"x": 2})
    text = "".join(open(tmp_path / "f" / f).read() for f in os.listdir(tmp_path / "f") if f.endswith(".csv"))
    assert '"a,b","1.0' in text and '"q""","-2.00","2"' in text
    sinks.write_matrix(df, "strategy", "k", "x", [1, 2, 3], str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == ["strategy", "1", "2", "3"]
    first = sinks.write_versioned(df, str(tmp_path / "v"))
    assert sinks.write_versioned(df, str(tmp_path / "v")) == first + ".v1"
    with pytest.raises(Exception, match="already exists"):
        sinks.write_table(df, str(tmp_path / "v"))


def test_stream_gives_what_the_batch_gives(spark, medium, tmp_path):
    events = spark.read.parquet(f"{medium}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withColumn("hit", (F.col("value") > 40).cast("double"))
    events.write.parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([("2030-01-01 00:00:00", "end", 0.0, 0.0)], "ts string, event_type string, value double, hit double").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    plan = counts.windowed_lift(stream, "ts", "hit", "value > 20", ["event_type"])
    query = plan.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    time.sleep(1)
    end.select(events.columns).write.mode("append").parquet(str(tmp_path / "in"))  # a later event closes the windows
    query = plan.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    wanted = counts.windowed_lift(events, "ts", "hit", "value > 20", ["event_type"])
    assert got.count() == wanted.count() > 0
    assert got.exceptAll(wanted).count() == 0
