"""Scheduled-job noise: cron events, gaps between them, false error labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions import fixed
from signalmill.functions.sql import contains_any
from signalmill.operators.ordered import BLOCK, first_per_key, last_before

RAPID_MS = 10_000


def cron_events(messages: DataFrame, index: str = "idx") -> DataFrame:
    """Messages about scheduled jobs. Row-local; needs session_id, `index`, timestamp, role, text."""
    text = F.col("text")
    named = text.contains("Cron")
    return messages.filter(text.rlike(fixed.CRON_LABEL) | named).select(
        "session_id",
        F.col(index).alias("idx"),
        F.col("timestamp").cast("string").alias("timestamp"),
        "role",
        (F.lower(text).contains("error") & named).alias("is_error"),
        F.substring(text, 1, 100).alias("preview"),
        F.length(text).alias("content_length"),
    )


def with_gaps(cron: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add `gap_ms`: time since the last earlier cron event that has a timestamp.

    A timestamp that does not parse gives no gap, to itself and to the next one.
    """
    stamped = F.nullif("timestamp", F.lit(""))
    earlier = last_before(cron, ["session_id"], "idx", stamped, "_earlier", block)

    def millis(text: str) -> Column:
        return F.unix_micros(F.try_to_timestamp(text)) / 1000

    return earlier.withColumn("gap_ms", millis("timestamp") - millis("_earlier")).drop("_earlier")


def false_error() -> Column:
    """Is a message that is labelled as an error worded like a good answer?"""
    return F.expr(f"is_error AND {contains_any('lower(preview)', fixed.SUCCESS_WORDS)}")


def gap_stats(gaps: DataFrame) -> DataFrame:
    """One row per session. The mean is taken over whole microseconds, so it does not depend on order."""
    micros = F.round(F.col("gap_ms") * 1000).cast("bigint")
    return gaps.groupBy("session_id").agg(
        F.count("*").alias("total_cron_events"),
        F.count_if("is_error").alias("error_labeled"),
        F.count_if(F.col("role") == "user").alias("user_role_cron"),
        F.count_if(F.col("gap_ms") < RAPID_MS).alias("rapid_fire_count"),
        F.min("gap_ms").alias("gap_min_ms"),
        F.max("gap_ms").alias("gap_max_ms"),
        (F.avg(micros) / 1000).alias("gap_mean_ms"),
        F.count_if(false_error()).alias("false_errors"),
    )


def error_samples(cron: DataFrame, limit: int = 5) -> DataFrame:
    """The first error-labelled events of a session."""
    errors = cron.filter("is_error")
    first = first_per_key(errors, ["session_id"], [F.col("idx")], limit)
    return first.select(
        "session_id",
        "idx",
        false_error().alias("has_successful_content"),
        F.substring("preview", 1, 50).alias("preview"),
    )
