"""Queries: streams over the events table, run to their end; results equal those of batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.plans.registry import query, rounded
from tracelab.plans.views import DUCK, SPARK, view
from tracelab.sources.scratch import scratch_path
from tracelab.streaming import live

STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_to_end(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", by: tuple[str, ...] = (), again: tuple[Callable[[], None], ...] = ()) -> DataFrame:
    """Runs the stream over all that is there, into Parquet in the shared folder, and reads the sink. Each of `again` adds to the source, and the stream goes on from its checkpoint."""
    path, at = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        for more in (lambda: None, *again):
            more()
            write = stream.writeStream.option("checkpointLocation", at).trigger(availableNow=True)
            if mode == "append":
                write.format("parquet").option("path", path).partitionBy(*by).start().awaitTermination()
            else:
                write.outputMode(mode).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{path}/batch={k}")).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(path)


def _source(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A stream over a table that is written from the given rows."""
    return _sliced(spark, [df], name)[0]


def _sliced(spark: SparkSession, parts: list[DataFrame], name: str) -> tuple[DataFrame, tuple[Callable[[], None], ...]]:
    """A stream over a table of the first part, and what adds the others."""
    path = scratch_path(spark, name)
    parts[0].write.parquet(path)
    return spark.readStream.schema(parts[0].schema).parquet(path), tuple(partial(lambda df: df.write.mode("append").parquet(path), df) for df in parts[1:])


@query(
    """with w as (select event_type as event, epoch_ms(date_trunc('hour', ts)) // 1000 as start_s, count(*) as n, round(sum(value), 4) as value from events group by 1, 2)
select * from w where start_s + 3600 <= (select max(epoch_us(ts)) // 1000000 from events) - 600"""
)
def w1_stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Hours that the watermark, ten minutes behind the last event, has passed."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("event"), "value")
    out = run_to_end(spark, live.stream_counters(_source(spark, rows, "w1"), "time", "1 hour", "10 minutes"), "counters")
    return rounded(out.select("event", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', start)").alias("start_s"), "n", "value"))


@query("select machine, time, status, ord from (select *, lag(status) over (partition by machine order by ord) as b from status) where b is distinct from status", "status")
def w2_stream_status_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "status").select("machine", "time", "status", "ord")
    return run_to_end(spark, live.stream_status_changes(_source(spark, rows, "w2"), ["machine"], "ord", "status"), "changes")


@query(
    """with steps as (select *, case when event = 'claim' then 1 else -1 end as step, sum(case when event = 'claim' then 1 else -1 end) over (partition by machine_id, property order by time, seq) as n from alloc_events)
select seq, time, machine_id, cast(sum(step * num_tasks * cpu + t * length(property)) over (partition by machine_id order by time, seq) as bigint) as used from (select *, case when n = 1 and step = 1 then 1 when n = 0 and step = -1 then -1 else 0 end as t from steps)""",
    "alloc_events",
)
def w3_stream_usage(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "alloc_events").select("seq", "time", "event", "machine_id", "num_tasks", F.col("cpu").alias("own"), "property", F.length("property").cast("bigint").alias("demand"))
    half = 1_296_000_000  # ms: the first of two batches ends here
    stream, more = _sliced(spark, [rows.where(F.col("time") <= half), rows.where(F.col("time") > half)], "w3")
    return run_to_end(spark, live.stream_usage(stream, "once"), "usage", again=more).drop("reserved")


@query(
    """with r as (select event_type, value, row_number() over (partition by event_type order by event_id desc) as k from events), x as (select event_type, value, row_number() over (partition by event_type order by value) as p, count(*) over (partition by event_type) as n from r where k <= 1000)
select event_type, count(*) as n, round(min(value), 6) as min, round(avg(value), 6) as mean, round(max(case when p = n // 2 + 1 then value end), 6) as median, round(max(value), 6) as max from x group by event_type"""
)
def w4_stream_last_n(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "value", "event_id")
    out = run_to_end(spark, live.stream_last_n(_source(spark, rows, "w4"), "event_type", "value", "event_id", 1000), "last-n", "update")
    last = out.groupBy("event_type").agg(F.max_by(F.struct("n", "min", "mean", "median", "max"), "batch").alias("x"))
    return rounded(last.select("event_type", "x.*"), 6)


#: Every tenth event comes a slice of ten days late, every eleventh two; a few are after the end.
DELAY, END, SLICE = 86_400_000, 2_550_000_000, 864_000_000
ARRIVALS = f"told as (select event_id, event_type, MS(ts) as time, least(3, cast(floor(MS(ts) / {SLICE}) as bigint) + case when event_id % 11 = 0 then 2 when event_id % 10 = 0 then 1 else 0 end) as slice from events)"


@query(
    f"""with {ARRIVALS.replace("MS(ts)", DUCK["MS"].replace(chr(92) + "1", "ts"))}, b as (select event_type, slice, max(time) filter (where time <= {END}) as latest from told group by all), w as (select event_type, s as slice, max(latest) as latest from b, (select unnest(range(4)) as s) where b.slice < s group by all)
select event_id, event_type, case when time > {END} then 'beyond' when time < latest - {DELAY} then 'late' else 'on time' end as arrival from told left join w using (event_type, slice)"""
)
def w5_late_events(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of all sinks: those on time, those that came over a day after their kind's latest, those after the end."""
    rows = spark.sql(f"with {ARRIVALS.replace('MS(ts)', SPARK['MS'].replace(chr(92) + '1', 'ts')).replace('from events', f'from parquet.`{sf}/events.parquet`')} select * from told")
    slices = [rows.where(F.col("slice") == k).select("event_id", "event_type", "time") for k in range(4)]
    stream, more = _sliced(spark, slices, "w5")
    out = run_to_end(spark, live.split_late(stream, ["event_type"], "time", DELAY, END), "arrivals", by=("arrival",), again=more)
    return out.select("event_id", "event_type", "arrival")
