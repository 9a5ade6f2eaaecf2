"""The driver's tables as metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.histograms import CUSTOM
from ..functions.histograms import DDL as HISTOGRAM
from ..operators.along import running
from .series import Catalog, FrameSource, from_table

#: Running sums are taken a week at a time: a counter over all events isn't one task.
CHUNK = 604_800_000_000
#: Upper bounds of the classic histogram's buckets.
BOUNDS = ("1", "5", "10", "50", "100", "500", "+Inf")


#: Bounds of the native histogram with custom buckets; zero bucket of the exponential one.
CUSTOM_BOUNDS, ZERO = (1.0, 5.0, 10.0, 50.0, 100.0, 500.0), 0.001
#: In place of a bucket's number: the zero bucket.
ZERO_BUCKET = -1000
HOUR_MS = 3_600_000


def hourly_histogram(events: DataFrame, name: str, custom: bool) -> FrameSource:
    """Native histograms of ``value`` by event type: counters, a sample at the end of each hour with events.

    One row for each (type, hour, bucket) is the most that is held; running sums go along
    each bucket's hours.
    """
    v = F.col("value")
    number = sum((v > b).cast("int") for b in CUSTOM_BOUNDS) if custom else F.when(v <= ZERO, ZERO_BUCKET).otherwise(F.ceil(F.log2(v)).cast("int"))
    t = (F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / HOUR_MS).cast("long") + 1) * HOUR_MS
    cells = events.select("event_type", t.alias("t"), number.alias("i"), v).groupBy("event_type", "t", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    every = cells.select("event_type", "t").distinct().join(cells.select("event_type", "i").distinct(), "event_type")
    full = every.join(cells, ["event_type", "t", "i"], "left").fillna(0, ["n"]).fillna(0.0, ["s"])
    full = running(running(full, ["event_type", "i"], F.col("n"), "c"), ["event_type", "i"], F.col("s"), "total")
    counted = (F.col("i") != ZERO_BUCKET) & (F.col("c") > 0)
    h = full.groupBy("event_type", "t").agg(
        F.map_from_entries(F.collect_list(F.when(counted, F.struct("i", F.col("c").cast("double"))))).alias("pos"),
        F.sum("c").cast("double").alias("count"), F.sum("total").alias("sum"), F.sum(F.when(F.col("i") == ZERO_BUCKET, F.col("c")).otherwise(0)).cast("double").alias("zero_count"),
    )
    bounds = F.array(*map(F.lit, CUSTOM_BOUNDS)) if custom else F.array().cast("array<double>")
    none = F.create_map().cast("map<int,double>")
    parts = {"schema": F.lit(CUSTOM if custom else 0), "count": F.col("count"), "sum": F.col("sum"), "zero_threshold": F.lit(0.0 if custom else ZERO), "zero_count": F.col("zero_count"), "pos": F.col("pos"), "neg": none, "custom": bounds, "hint": F.lit(0).cast("tinyint")}
    h = h.select("event_type", "t", F.struct(*[c.alias(n) for n, c in parts.items()]).cast(HISTOGRAM).alias("h"))
    return from_table(h, name, {"event_type": "event_type"}, "t", F.lit(None).cast("double"), h="h")


def table_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Metrics over events, lineitem, orders and customer; each table is opened on first use.

    event_value{event_type,user_id} gauge; event_value_total counter (running sum per
    series); events_total{event_type} counter; event_value_bucket{event_type,le}
    cumulative histogram; event_value_native and event_value_custom{event_type} native
    histograms, exponential and with custom bounds; line_quantity{returnflag,linestatus} and
    order_price{status,priority} daily gauges; customer_info{user_id,segment} constant 1.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    user = {"event_type": "event_type", "user_id": "user_id"}

    def summed(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
        """Counter: column value is the running sum by ts; whole microseconds order the samples."""
        df = df.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
        return running(df, keys, value, "value", CHUNK, "__us").drop("__us")

    def event_value() -> FrameSource:
        return from_table(read("events"), "event_value", user, "ts", "value")

    def event_value_total() -> FrameSource:
        df = summed(read("events").select("event_type", "user_id", "ts", "value"), ["event_type", "user_id"], F.col("value"))
        return from_table(df, "event_value_total", user, "ts", "value")

    def events_total() -> FrameSource:
        df = summed(read("events").select("event_type", "ts"), ["event_type"], F.lit(1))
        return from_table(df, "events_total", {"event_type": "event_type"}, "ts", "value")

    def event_value_bucket() -> FrameSource:
        le = F.explode(F.array(*map(F.lit, BOUNDS)))
        rows = read("events").select("event_type", "ts", "value", le.alias("le"))
        inside = F.when(F.col("le") == "+Inf", F.lit(1)).otherwise((F.col("value") <= F.col("le").try_cast("double")).cast("int"))
        return from_table(summed(rows, ["event_type", "le"], inside), "event_value_bucket", {"event_type": "event_type", "le": "le"}, "ts", "value")

    def daily(table: str, name: str, labels: dict[str, str], day: str, value: str) -> FrameSource:
        keys = [F.col(c).alias(x) for x, c in labels.items()]
        df = read(table).groupBy(*keys, F.col(day).alias("day")).agg(F.sum(value).alias("value"))
        return from_table(df, name, {x: x for x in labels}, "day", "value")

    def customer_info() -> FrameSource:
        # An info metric: one sample an hour over the events' month would be stored; here it is made.
        df = read("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
        hours = F.explode(F.expr("sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-02-01 00:00:00', interval 6 hours)"))
        return from_table(df.select("*", hours.alias("ts")), "customer_info", {"user_id": "user_id", "segment": "segment"}, "ts", F.lit(1.0))

    return Catalog({
        "event_value": event_value,
        "event_value_total": event_value_total,
        "events_total": events_total,
        "event_value_bucket": event_value_bucket,
        "event_value_native": lambda: hourly_histogram(read("events"), "event_value_native", custom=False),
        "event_value_custom": lambda: hourly_histogram(read("events"), "event_value_custom", custom=True),
        "line_quantity": lambda: daily("lineitem", "line_quantity", {"returnflag": "l_returnflag", "linestatus": "l_linestatus"}, "l_shipdate", "l_quantity"),
        "order_price": lambda: daily("orders", "order_price", {"status": "o_orderstatus", "priority": "o_orderpriority"}, "o_orderdate", "o_totalprice"),
        "customer_info": customer_info,
    })
