"""Pages as a data source: what counts, what is opened, and as a stream."""

from __future__ import annotations

from helpers import at, bars
from pyspark.sql import functions as F

from tapeweave.sources import paged
from tapeweave.sources.store import shared_path


def _table(spark, n=95, symbols=("AA", "B/B:X")):
    out = None
    for s in symbols:
        one = bars(spark, [100.0 + k for k in range(n)], symbol=s)
        out = one if out is None else out.unionByName(one)
    return out


def _rows(df):
    return sorted((r.symbol, r.ts, r.close) for r in df.collect())


def test_pages_are_partitions_and_conditions_choose_them(spark):
    path = shared_path(spark, "pages")
    table = _table(spark)
    paged.land_pages(table, path, 10)
    got = paged.read_pages(spark, path, 10)
    assert _rows(got) == _rows(table) and got.rdd.getNumPartitions() == 20
    one = paged.read_pages(spark, path, 10).where("symbol = 'B/B:X'")
    assert one.count() == 95 and one.rdd.getNumPartitions() == 10
    late = paged.read_pages(spark, path, 10).where((F.col("symbol") == "AA") & (F.col("ts") >= F.lit(at(72))) & (F.col("ts") < F.lit(at(80))))
    assert [r.ts for r in late.orderBy("ts").collect()] == [at(k) for k in range(72, 80)]
    assert late.rdd.getNumPartitions() <= 2


def test_a_run_ends_with_a_short_or_unmoving_page(spark):
    path = shared_path(spark, "pages")
    table = _table(spark, 40, ("AA",))
    first, short, behind = table.where(F.col("ts") < F.lit(at(10))), table.where(F.col("ts").between(F.lit(at(10)), F.lit(at(15)))), table.where(F.col("ts") >= F.lit(at(30)))

    def land(df, run, number):
        df.select("*", F.lit(0).alias("place"), F.lit("AA").alias("symbol_dir"), F.lit(run).alias("run"), F.lit(number).alias("page")).coalesce(1).write.mode("append").partitionBy("symbol_dir", "run", "page").parquet(path)

    for number, df in enumerate((first, short, behind)):
        land(df, 0, number)  # the short page ends the run
    for number, df in enumerate((behind, first, short)):
        land(df, 1, number)  # the second page does not advance
    pages = paged.counted(paged._pages(path), 10)
    assert [(p.run, p.page) for p in pages] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert paged.read_pages(spark, path, 10).count() == 10 + 6 + 10 + 10
    assert paged.read_pages(spark, shared_path(spark, "none"), 10).count() == 0


def test_the_stream_goes_on_from_its_page(spark):
    path, folder = shared_path(spark, "pages"), shared_path(spark, "stream")
    table = _table(spark)

    def run():
        stream = paged.read_pages(spark, path, 10, stream=True, pages=3).drop("arrival")
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{folder}/rows")

    paged.land_pages(table.where(F.col("ts") < F.lit(at(60))), path, 10)
    # three pages of a symbol a batch, and a batch a run
    assert [run().count() for _ in range(3)] == [60, 120, 120]
    paged.land_pages(table.where(F.col("ts") >= F.lit(at(60))), path, 10, run=1)
    run()
    assert _rows(run()) == _rows(table)


def test_the_audit_comes_from_the_pass_that_writes(spark):
    import pytest

    from tapeweave.operators import quality
    from tapeweave.sources.store import read_candles

    source, path = shared_path(spark, "raw"), shared_path(spark, "audited")
    table = _table(spark, 40).where(~F.col("ts").isin(at(7), at(8)))
    dirty = table.unionByName(table.where(F.col("ts") < F.lit(at(3))).withColumn("high", F.col("low") - 1)).withColumn("close", F.when(F.col("ts") == F.lit(at(9)), None).otherwise(F.col("close")))
    dirty.write.parquet(source)
    raw = spark.read.parquet(source)
    got = quality.land_audited(raw, path, "4h", ["AA", "B/B:X", "none"], 4 * 3600)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, quality.report(raw, 4 * 3600).collect()))
    kept = read_candles(spark, path)
    assert kept.count() == raw.select("symbol", "ts").distinct().count() == 76
    # figures and files come from one scan
    store = spark._jsparkSession.sharedState().statusStore()
    plans = [store.execution(k).get().physicalPlanDescription() for k in range(store.executionsCount()) if store.execution(k).isDefined()]
    writes = [p for p in plans if "CollectMetrics" in p]
    assert writes and all(p.count("FileScan parquet") + p.count("Scan parquet ") >= 1 and p.count("+- Scan parquet") <= 2 for p in writes[-1:])
    with pytest.raises(ValueError, match="watchlist"):
        quality.land_audited(raw, shared_path(spark, "audited"), "4h", ["AA"], 4 * 3600)


def test_summary_by_group_holds_no_group(spark):
    from tapeweave.operators import metrics

    rows = [(k, ["a", "b", None][k % 3], (k * 37 % 101) / 10 - 4, k % 17) for k in range(300)]
    trades = spark.createDataFrame(rows, "seq long, g string, pnl_r double, bars long").selectExpr("*", "pnl_r / 100 AS pnl_pct", "10000.0 + pnl_r AS capital_after", "0.0 AS mae_pct", "0.0 AS mfe_pct")
    got = metrics.summary(trades, 10_000.0, ("g",))
    assert "median(" not in got._jdf.queryExecution().optimizedPlan().toString()
    import statistics

    want = {g: (statistics.median(r[2] for r in rows if r[1] == g), statistics.median(r[3] for r in rows if r[1] == g) * 0.25) for g in ("a", "b", None)}
    have = {r.g: (r.median_r, r.median_hours) for r in got.collect()}
    assert have.keys() == want.keys() and all(abs(a - b) < 1e-12 for g in want for a, b in zip(have[g], want[g]))
