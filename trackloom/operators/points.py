"""Match rules on top of rallies: quiet periods, padding, scores, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .gaps import hidden_runs


def quiet_periods(trajectory: DataFrame, videos: DataFrame, seconds: float = 2.5) -> DataFrame:
    """Runs without a visible object that last long enough."""
    runs = hidden_runs(trajectory).join(videos, "video_id").where(F.col("length") / F.col("fps") >= seconds)
    return runs.select("video_id", "run_start", "run_end", (F.col("length") / F.col("fps")).alias("seconds"))


def padded_bounds(rallies: DataFrame, lead: float = 2.0, tail: float = 1.5, after_quiet: float = 0.2) -> DataFrame:
    """Bounds with a lead and a tail; the lead does not reach into the rally before."""
    order = Window.partitionBy("video_id").orderBy("rally")
    quiet = F.lag("end_seconds").over(order)
    start = F.greatest(F.col("start_seconds") - lead, F.coalesce(quiet + after_quiet, F.lit(0.0)))
    return rallies.select("video_id", "rally", start.alias("start"), (F.col("end_seconds") + tail).alias("end"))


def absence_kind(seconds: Column) -> Column:
    """Whether an object that left is expected back."""
    return F.when(seconds <= 3.0, "transient").otherwise("terminal")


def structure_checks(rallies: DataFrame) -> DataFrame:
    """What is odd about each rally: too short, too long, no quiet before it."""
    order = Window.partitionBy("video_id").orderBy("rally")
    length = F.col("end_seconds") - F.col("start_seconds")
    pause = F.col("start_seconds") - F.lag("end_seconds").over(order)
    odd = F.array_compact(F.array(F.when(length < 1.5, "short"), F.when(length > 60, "long"), F.when(pause < 2.5, "no_quiet")))
    return rallies.select("video_id", "rally", odd.alias("checks"))


def running_score(points: DataFrame) -> DataFrame:
    """Score after each outcome (A_POINT, B_POINT, others do not count), and who serves next."""
    order = Window.partitionBy("video_id").orderBy("rally")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    scored = F.when(F.col("outcome").isin("A_POINT", "B_POINT"), F.left("outcome", F.lit(1)))
    return points.select(
        "video_id", "rally", "outcome", F.sum((F.col("outcome") == "A_POINT").cast("int")).over(so_far).alias("a"),
        F.sum((F.col("outcome") == "B_POINT").cast("int")).over(so_far).alias("b"), F.last(scored, ignorenulls=True).over(so_far).alias("server"),
    )


def coalesce_runs(points: DataFrame, outcome: str = "NON_RALLY") -> DataFrame:
    """Consecutive rows of one outcome as one row."""
    order = Window.partitionBy("video_id").orderBy("rally")
    begins = F.when((F.col("outcome") == outcome) & (F.lag("outcome").over(order) == outcome), 0).otherwise(1)
    marked = points.withColumn("_b", begins).withColumn("_run", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("video_id", "_run").agg(F.min("rally").alias("first"), F.max("rally").alias("last"), F.min("outcome").alias("outcome")).drop("_run")
