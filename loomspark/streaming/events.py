"""Event streams: windows with watermarks, deduplication, append sinks, and a limiter that counts admitted requests only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, ts: str, kind: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, end, kind, events): counts by window; rows later than the watermark are left out of a stream, not of a batch."""
    rows = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.window("_t", size).alias("w"), kind).agg(F.count("*").alias("events")).select("w.start", "w.end", kind, "events")


def session_counts(events: DataFrame, ts: str, who: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.session_window("_t", gap).alias("w"), who).agg(F.count("*").alias("events")).select("w.start", "w.end", who, "events")


def once(events: DataFrame, ts: str, key: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark's time, however often it is redelivered."""
    return events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(key).drop("_t")


def limited(requests: DataFrame, client: str, ts: str, id: str, most: int, seconds: int, late: str = "2 hours") -> DataFrame:
    """(client, id, admitted): the stream twin of the batch limiter. A client's state is its last `most` admitted times, and is dropped when the watermark has
    passed the window of the last one.

    Requests are decided as they come, those of one micro-batch in the order of their time: what came in order is decided as the batch twin does; a
    request that comes after later ones of its client meets the state that those left. Requests later than the watermark are left out."""
    kinds = dict(requests.dtypes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["_s", id])
        flags = []
        for t in pdf["_s"]:
            recent = [r for r in recent if r > t - seconds]
            ok = len(recent) < most
            if ok:
                recent.append(float(t))
            flags.append(ok)
        state.update((recent,))
        ends = max(recent, default=float(pdf["_s"].max())) + seconds
        state.setTimeoutTimestamp(max(int(ends * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({client: [key[0]] * len(pdf), id: pdf[id].tolist(), "admitted": flags})

    rows = requests.select(client, id, F.col(ts).cast("timestamp").alias("_t")).withColumn("_s", F.col("_t").cast("double")).withWatermark("_t", late)
    return rows.groupBy(client).applyInPandasWithState(step, f"{client} {kinds[client]}, {id} {kinds[id]}, admitted boolean", "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def append_log(stream: DataFrame, path: str, checkpoint: str, line: Callable[[DataFrame], DataFrame] = lambda df: df):
    """All that has come, appended once: a batch that is repeated after a failure overwrites its own folder."""
    def put(df: DataFrame, batch: int) -> None:
        line(df).write.mode("overwrite").json(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
