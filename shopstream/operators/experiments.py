"""Experiments: assignment (D8), arm statistics (A20) and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import bucket_of, normal_cdf
from .rollup import SEARCHES, count_type


def assign_arms(sessions: DataFrame, experiments: DataFrame) -> DataFrame:
    """(site_id, session_id, experiment_id, bucket, arm). experiments: (site_id, experiment_id, exposure), a short table that is sent to the sessions; a session's bucket decides, an empty session is in the control arm."""
    rows = sessions.join(experiments, "site_id")
    bucket = F.when(F.coalesce(F.col("session_id"), F.lit("")) != "", bucket_of(F.col("experiment_id"), F.col("session_id")))
    rows = rows.withColumn("bucket", bucket)
    return rows.select("site_id", "session_id", "experiment_id", "bucket", F.when(F.col("bucket") < F.col("exposure"), "treatment").otherwise("control").alias("arm"))


def arm_stats(events: DataFrame, arms: DataFrame) -> DataFrame:
    """For each experiment and arm: sessions, searches, sessions that clicked, carted and bought, revenue, first and last event."""
    sessions = lambda kind: F.count_distinct(F.when(F.col("type") == kind, F.col("session_id")))
    return events.join(arms, ["site_id", "session_id"]).groupBy("site_id", "experiment_id", "arm").agg(
        F.count_distinct("session_id").alias("sessions"),
        count_type(*SEARCHES).alias("searches"),
        sessions("click").alias("clicked"),
        sessions("add_to_cart").alias("carted"),
        sessions("purchase").alias("bought"),
        F.round(F.coalesce(F.sum("revenue"), F.lit(0.0)), 2).alias("revenue"),
        F.min("occurred_at").alias("started"),
        F.max("occurred_at").alias("ended"),
    )


def experiment_results(stats: DataFrame, least_sessions: int = 100, sure: float = 0.95) -> DataFrame:
    """For each experiment: cart rates of the arms, lift in per cent, confidence of a pooled two-proportion z-test, sessions needed for an arm, and a verdict."""
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    rows = stats.groupBy("site_id", "experiment_id").agg(*[F.coalesce(pick(arm, c), F.lit(0)).cast("double").alias(f"{arm[0]}_{c}") for arm in ("control", "treatment") for c in ("sessions", "carted")])
    n1, n2 = F.col("c_sessions"), F.col("t_sessions")
    p1, p2 = F.coalesce(F.try_divide("c_carted", "c_sessions"), F.lit(0.0)), F.coalesce(F.try_divide("t_carted", "t_sessions"), F.lit(0.0))
    rows = rows.withColumns({"control_rate": p1, "treatment_rate": p2})
    p1, p2 = F.col("control_rate"), F.col("treatment_rate")
    pooled = (F.col("c_carted") + F.col("t_carted")) / (n1 + n2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    z = F.when((n1 > 0) & (n2 > 0) & (error > 0), (p2 - p1) / error).otherwise(0.0)
    rows = rows.withColumn("z", z).withColumn("confidence", 2 * normal_cdf(F.abs("z")) - 1)
    mid, delta = (p1 + p2) / 2, F.abs(p2 - p1)
    needed = F.when(delta > 0, F.ceil((1.96 + 0.84) * (1.96 + 0.84) * 2 * mid * (1 - mid) / (delta * delta)))
    verdict = F.when((n1 < least_sessions) | (n2 < least_sessions), "not_enough_data").when(F.col("confidence") < sure, "no_difference").when(p2 > p1, "treatment_wins").otherwise("control_wins")
    lift = F.when(p1 > 0, F.round(100 * (p2 - p1) / p1, 4))
    return rows.select("site_id", "experiment_id", F.col("c_sessions").cast("long").alias("control_sessions"), F.col("t_sessions").cast("long").alias("treatment_sessions"), F.round(p1, 6).alias("control_rate"), F.round(p2, 6).alias("treatment_rate"), lift.alias("lift"), F.round("confidence", 6).alias("confidence"), needed.cast("long").alias("sessions_needed"), verdict.alias("verdict"))
