"""Job events: states, progress, idleness, window counts (batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.plans.skew import attach

TERMINAL = ["complete", "error", "cancelled"]
IDLE_SECONDS = 3600
HISTORY = 500


def _place() -> Column:
    return F.struct("ts", "event_id")


def job_state(events: DataFrame) -> DataFrame:
    """State per job: a cancel always wins, else the first complete or error, else running if started.

    One aggregation with map-side combine; events of a busy job are never brought together.
    """
    kind = F.col("event_type")
    ended = F.when(kind.isin("complete", "error"), _place())
    cancelled = F.when(kind == "cancelled", _place())
    per_job = events.groupBy("job_id").agg(
        F.min_by(F.struct("event_type", "event_id"), ended).alias("first_end"),
        F.max_by("event_id", cancelled).alias("cancel_id"),
        F.bool_or(kind == "started").alias("started"),
        F.count(F.lit(1)).alias("events"),
    )
    state = (
        F.when(F.col("cancel_id").isNotNull(), "cancelled").when(F.col("first_end.event_type") == "complete", "completed")
        .when(F.col("first_end.event_type") == "error", "failed").when(F.col("started"), "running").otherwise("pending")
    )
    return per_job.select(
        "job_id", state.alias("state"), F.coalesce("cancel_id", "first_end.event_id").alias("ended_by"), "events"
    )


def latest_progress(events: DataFrame) -> DataFrame:
    """Last progress of each job before it ended; later progress is an orphan and dropped."""
    ends = events.groupBy("job_id").agg(
        F.min(F.when(F.col("event_type").isin(TERMINAL), _place())).alias("__end"),
        F.count_if(F.col("event_type") == "progress").alias("__n"),
    )
    progress = events.filter("event_type = 'progress'").select("job_id", "ts", "event_id", "value")
    timely = attach(progress, ends, ["job_id"], "__n", spread=["event_id"]).filter(
        F.col("__end").isNull() | (_place() < F.col("__end"))
    )
    return timely.groupBy("job_id").agg(F.max_by(F.struct("event_id", "value"), _place()).alias("p")).select(
        "job_id", "p.event_id", "p.value"
    )


def expire_idle(events: DataFrame, now: Column | None = None, gap_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Ended jobs without activity for longer than the gap at ``now`` (default: the newest event)."""
    per_job = events.groupBy("job_id").agg(
        F.max("ts").alias("last_activity"), F.bool_or(F.col("event_type").isin(TERMINAL)).alias("ended")
    )
    if now is None:
        now = events.agg(F.max("ts").alias("now")).scalar()
    old = F.col("last_activity") + F.make_dt_interval(secs=F.lit(gap_seconds)) < now
    return per_job.filter(F.col("ended") & old).select("job_id", "last_activity")


def activity_sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Stretches of activity per job that end after a gap without events."""
    return events.groupBy("job_id", F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("events"), F.bool_or(F.col("event_type").isin(TERMINAL)).alias("ended")
    ).select("job_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "events", "ended")


def event_counts(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events per type and window; sliding when ``slide`` is given. Works on streams as well."""
    w = F.window("ts", width) if slide is None else F.window("ts", width, slide)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), "event_type", "n"
    )


def last_n_events(events: DataFrame, n: int = HISTORY) -> DataFrame:
    """Newest ``n`` events of each job; map tasks keep only their own newest ``n`` per job first."""
    newest = Window.partitionBy("job_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return events.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= n).drop("__n")


def active_counts(states: DataFrame) -> DataFrame:
    return states.agg(
        F.count_if(F.col("state") == "running").alias("running"),
        F.count_if(F.col("state") == "pending").alias("pending"),
        F.count_if(F.col("state").isin("running", "pending")).alias("active"),
    )
