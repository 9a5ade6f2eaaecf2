import datetime as dt
import math

from pulsegrid.engine import MetricsEngine
from pulsegrid.sources.series import FrameSource
from pulsegrid.streaming import stream_rate, stream_windows
from pulsegrid.streaming.windows import last_values


def batches(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=10 * i + k), f"s{k}", float(i * 3 if i < 9 else i - 9)) for i in range(20) for k in (0, 1)]
    rows.append((dt.datetime(2024, 1, 2), "end", 0.0))
    for i, part in enumerate((rows[:20], rows[20:40], rows[40:])):
        spark.createDataFrame(part, "ts timestamp, name string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={i}"))
    return rows


def drained(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path):
    return spark.readStream.schema("ts timestamp, name string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def test_windows_equal_the_batch_engine(spark, tmp_path):
    rows = batches(spark, tmp_path)
    start, width, step = 1_704_067_200_000, 60_000, 30_000
    base = spark.createDataFrame([(name, round(ts.replace(tzinfo=dt.UTC).timestamp() * 1000), v) for ts, name, v in rows], "l_name string, t long, v double")
    engine = MetricsEngine(spark, FrameSource(base, "m_total"))
    for fn, df in (("rate", lambda s: stream_rate(s, ["name"], width, step, 0)), ("max_over_time", lambda s: stream_windows(s, "max_over_time", ["name"], width, step, 0)), ("count_over_time", lambda s: stream_windows(s, "count_over_time", ["name"], width, step, 0))):
        got = {(r["name"], r["step"]): r["v"] for r in drained(spark, df(source(spark, tmp_path)), tmp_path, fn).collect() if r["name"] != "end"}
        want = {(r["name"], r["step"]): r["v"] for r in engine.range(f"{fn}(m_total[1m])", start, start + 300_000, step).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_silent_series_go_stale(spark, tmp_path):
    batches(spark, tmp_path)
    out = drained(spark, last_values(source(spark, tmp_path), "name", 3_600_000), tmp_path, "stale").orderBy("t").collect()
    newest = {r["name"]: r["v"] for r in out if not r["stale"]}
    assert newest["s0"] == 10.0 and newest["end"] == 0.0
    assert {r["name"] for r in out if r["stale"]} <= {"s0", "s1"}
