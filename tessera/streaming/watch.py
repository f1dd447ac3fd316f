"""Change streams: debounced batches, snapshot differences, upserts by micro-batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import updates


def debounce(events: DataFrame, ts: str = "ts", key: str | tuple[str, ...] | None = None, delay_ms: int = 300) -> DataFrame:
    """``events`` with ``batch_start``: the first event opens a batch that takes all within a fixed delay of it.

    This is a delay from the first event, not a gap between events, so batches
    follow from one another, over midnight too. A stretch without a gap longer than
    the delay is independent of any other; stretches are found by windows of a day,
    joined at the days' ends, and each is walked by one fold over its sorted times.
    """
    by = [key] if isinstance(key, str) else list(key or ())
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    src = events.where(F.col(ts).isNotNull()).withColumn("_t", t).withColumn("_day", F.floor(t / F.lit(86_400_000_000)))
    step = delay_ms * 1000
    w, days = Window.partitionBy(*by, "_day").orderBy("_t"), Window.partitionBy(*by).orderBy("_day")
    gaps = src.withColumn("_open", (F.col("_t") - F.lag("_t").over(w) > step).cast("int"))
    # the first event of a day opens a stretch unless the last one of the day before it is near
    ends = gaps.groupBy(*by, "_day").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.coalesce(F.sum("_open"), F.lit(0)).alias("_gaps"))
    new = F.coalesce((F.col("_first") - F.lag("_last").over(days) > step).cast("int"), F.lit(1))
    base = ends.withColumn("_new", new).withColumn("_base", F.sum(F.col("_gaps") + F.col("_new")).over(days) - F.col("_gaps")).select(*by, "_day", "_base")
    runs = gaps.join(base, [*by, "_day"]).withColumn("_run", F.col("_base") + F.coalesce(F.sum("_open").over(w), F.lit(0)))
    times = runs.groupBy(*by, "_run").agg(F.sort_array(F.collect_set("_t")).alias("_ts"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = b.column("_ts")[i].values.to_numpy()
                start, at = np.empty(len(x), np.int64), 0
                while at < len(x):
                    end = int(np.searchsorted(x, x[at] + step, "right"))
                    start[at:end] = x[at]
                    at = end
                yield pa.RecordBatch.from_arrays([*(pa.repeat(b.column(c)[i], len(x)) for c in (*by, "_run")), pa.array(x), pa.array(start)], [*by, "_run", "_t", "_start"])

    kinds = dict(times.dtypes)
    begun = times.mapInArrow(walk, ", ".join(f"`{c}` {kinds[c]}" for c in (*by, "_run")) + ", _t bigint, _start bigint")
    j = runs.join(begun, [*by, "_run", "_t"])
    return j.withColumn("batch_start", F.timestamp_micros("_start")).select(*events.columns, "batch_start")


def bursts(look: Callable[[], object], delay_ms: int = 300, rounds: int | None = None, idle_ms: int = 50) -> Iterator[object]:
    """States of a watched thing, one for each burst of changes.

    ``look`` gives the state now. The first difference opens a burst, which closes
    a fixed delay later whatever comes in between, as with ``debounce``. The first
    look counts as a change. Ends after ``rounds`` bursts or quiet delays.
    """
    last: object = None
    while rounds is None or rounds > 0:
        waited = 0
        while (now := look()) == last and (rounds is None or waited < delay_ms):
            time.sleep(idle_ms / 1000)
            waited += idle_ms
        rounds = None if rounds is None else rounds - 1
        if now == last:
            continue
        if last is not None:
            time.sleep(delay_ms / 1000)
            now = look()
        last = now
        yield now


def file_events(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(folder)


def upsert_stream(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str, order: str, checkpoint: str):
    """Apply each micro-batch to a table: the latest row of each key in the batch takes the old one's place.

    ``read`` gives the table, ``write`` puts a new version in force. Running a batch
    again gives the same table, so a restart is safe.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            write(updates.upsert(read(), updates.latest(batch, key, order), key))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of tumbling windows, with a watermark; for streams and tables alike."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return e.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
