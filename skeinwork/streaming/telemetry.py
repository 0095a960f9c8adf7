"""Structured Streaming forms of the telemetry operators, and the rollback state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinwork.operators import telemetry
from skeinwork.session import shared_dir

LATE = "2 days"
STATES = ("healthy", "watching", "degraded", "rolling_back", "rolled_back", "recovering")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream; event time gets a zone, as watermarks need one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_stream(events: DataFrame, length: str = "5 minutes", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Counts per window; rows later than `late` behind the newest are left out, and closed windows leave the state."""
    return telemetry.windowed(events.withWatermark("ts", late), length, slide)


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    return telemetry.sessions(events.withWatermark("ts", late), gap)


def deduplicated_stream(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event_id once within the lateness that is allowed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def next_state(state: str, bad: bool) -> str:
    """One step of the rollback machine: two bad readings in a row degrade, the third rolls back, good ones recover."""
    if bad:
        return {"healthy": "watching", "watching": "degraded", "degraded": "rolling_back", "rolling_back": "rolled_back", "rolled_back": "rolled_back", "recovering": "degraded"}[state]
    return {"healthy": "healthy", "watching": "healthy", "degraded": "watching", "rolling_back": "rolled_back", "rolled_back": "recovering", "recovering": "healthy"}[state]


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get[0] if state.exists else "healthy"
    rows = pd.concat(list(batches)).sort_values(["minute", "bad"], kind="stable")
    out = []
    for r in rows.itertuples():
        now = next_state(now, bool(r.bad))
        out.append((key[0], r.minute, now))
    state.update((now,))
    yield pd.DataFrame(out, columns=["component", "minute", "state"])


def rollback_states(readings: DataFrame) -> DataFrame:
    """(component, minute, state) of a stream of (component string, minute long, bad boolean): one small state a component."""
    return readings.groupBy("component").applyInPandasWithState(_step, "component string, minute long, state string", "state string", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Work off all there is now and return the result as a table: for catching up, and for tests against the batch form."""
    spark = stream.sparkSession
    import uuid

    at = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
