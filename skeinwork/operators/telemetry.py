"""Roll-ups, guardrails and experiments over events (ts, user_id, event_type, value). Work on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions.strings import bucket_of

ARMS = ((20, "control"), (60, "A"), (100, "B"))


def arm_of(user: Column, experiment: str) -> Column:
    """control, A or B by the user's hash bucket: the same user always has the same arm."""
    b = bucket_of(F.concat(user.cast("string"), F.lit(f":{experiment}")))
    out = F.lit(ARMS[-1][1])
    for limit, name in reversed(ARMS[:-1]):
        out = F.when(b < limit, name).otherwise(out)
    return out


def alpha_of(history: Column) -> Column:
    return F.when(history <= 2, 0.2).when(history <= 10, 0.4).when(history <= 100, 0.6).otherwise(0.8)


def kind_counts() -> list[Column]:
    n = lambda k: F.count_if(F.col("event_type") == k)
    return [F.count("*").alias("events"), n("view").alias("views"), n("click").alias("clicks"), n("error").alias("errors"), n("purchase").alias("purchases")]


def rates(df: DataFrame) -> DataFrame:
    """Click-through and errors per 1,000 views."""
    return df.withColumns({"ctr": F.try_divide(F.col("clicks"), F.col("views")), "errors_per_1k": F.try_divide(F.col("errors") * 1000, F.col("views"))})


def roll_up(events: DataFrame, period: str) -> DataFrame:
    """Counts, rates, mean and depth (events a user) by day, week or month."""
    g = events.groupBy(F.date_trunc(period, F.col("ts")).alias("start")).agg(*kind_counts(), F.countDistinct("user_id").alias("users"), F.avg("value").alias("mean_value"))
    return rates(g).withColumn("depth", F.col("events") / F.col("users"))


def windowed(events: DataFrame, length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows of event time."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w")).agg(*kind_counts()).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "views", "clicks", "errors", "purchases")


def sustained(windows: DataFrame, breach: Column, times: int = 2) -> DataFrame:
    """Adds `alert`: the breach holds in this window and the times - 1 before it. Windows are few: one row each."""
    w = Window.partitionBy(F.to_date("start")).orderBy("start").rowsBetween(-(times - 1), 0)
    return windows.withColumn("alert", (F.sum(F.coalesce(breach, F.lit(False)).cast("int")).over(w) == times))


def anomalies(daily: DataFrame, value: str, by: str, limit: float = 2.0) -> DataFrame:
    """Adds `z` against the key's own mean and spread, and `anomalous`."""
    s = daily.groupBy(by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    d = daily.join(s, by).withColumn("z", F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s")
    return d.withColumn("anomalous", F.coalesce(F.abs("z") > limit, F.lit(False)))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, depth) of runs of events with no longer pause than `gap`."""
    g = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("depth"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "depth")


def journeys(events: DataFrame) -> DataFrame:
    """One row a view: the clicks and purchases of the same user before his next view, and whether they run forward.

    A view and what follows it share a number, so the 1:N join of requests to later events is a running count.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("view_no", F.count_if(F.col("event_type") == "view").over(w)).filter("view_no > 0")
    g = e.groupBy("user_id", "view_no").agg(F.min("ts").alias("first"), F.min(F.when(F.col("event_type") == "view", F.col("ts"))).alias("viewed"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    return g.withColumn("chronological", F.col("first") == F.col("viewed"))


def lift(by_arm: DataFrame, value: str, control: str = "control") -> DataFrame:
    """Adds the percentage over the control arm, and the share of traffic."""
    base = by_arm.filter(F.col("arm") == control).select(F.col(value).alias("__b"))
    total = by_arm.agg(F.sum("users").alias("__t"))
    j = by_arm.join(F.broadcast(base)).join(F.broadcast(total))
    return j.withColumns({"lift_percent": (F.try_divide(F.col(value), F.col("__b")) - 1) * 100, "traffic": F.col("users") / F.col("__t")}).drop("__b", "__t")


def anonymised(events: DataFrame, keep_days: int, today: Column) -> DataFrame:
    """User ids as SHA-256, only rows no older than the retention."""
    return events.filter(F.datediff(today, F.col("ts")) <= keep_days).withColumn("user_id", F.sha2(F.col("user_id").cast("string"), 256))


def cold_and_warm(events: DataFrame) -> DataFrame:
    """Percentiles of the first request of each user (cold) and the later ones (warm), and the share that was warm."""
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == 1
    e = events.withColumn("phase", F.when(first, "cold").otherwise("warm"))
    g = e.groupBy("phase").agg(F.count("*").alias("n"), F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"))
    return g.join(F.broadcast(e.agg(F.count("*").alias("t")))).select("phase", "n", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), (F.col("n") / F.col("t")).alias("share"))
