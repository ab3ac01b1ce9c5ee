import numpy as np
from ocuspark.functions.stencils import stencil_1d
from ocuspark.streaming import signals


def run(df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_stream_gives_the_interior_of_the_filter(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=40)
    for part in range(4):
        rows = [(1, i, float(x[i])) for i in range(part * 10, part * 10 + 10)]
        spark.createDataFrame(rows, "session long, i long, x double").selectExpr("session", "timestamp_seconds(i) ts", "x").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session long, ts timestamp, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.checkpointLocation", f"{tmp_path}/c")
    run(signals.savgol_stream(stream, 5, 2), "smooth")
    got = sorted((r.ts, r.y) for r in spark.table("smooth").collect())
    want = np.correlate(x, stencil_1d(5, 2), "valid")
    assert len(got) == 36 and np.allclose([y for _, y in got], want)
    run(signals.window_stats(signals.timed(stream, "1 second"), "10 seconds"), "stats")
    assert [r.n for r in spark.table("stats").orderBy("start").collect()] == [10, 10, 10]
