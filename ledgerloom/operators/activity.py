"""Live processing state and error history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.times import duration_ms, elapsed_seconds
from ledgerloom.limits import DEFAULT, Limits
from ledgerloom.operators.scans import running


def open_requests(events: DataFrame, now: Column) -> DataFrame:
    """Requests that have started and not ended by ``now``."""
    seen = events.filter(F.col("ts") <= now)
    started = F.col("kind") == "start"
    requests = seen.groupBy("token").agg(
        F.max(F.when(started, F.col("request_id"))).alias("request_id"),
        F.max(F.when(started, F.col("operation"))).alias("operation"),
        F.min(F.when(started, F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("kind") == "end", F.col("ts"))).alias("_ended_at"),
    )
    is_open = F.col("started_at").isNotNull() & F.col("_ended_at").isNull()
    return requests.filter(is_open).select(
        "token",
        "request_id",
        "operation",
        F.lit("processing").alias("phase"),
        "started_at",
        elapsed_seconds(F.col("started_at"), now).alias("elapsed_seconds"),
    )


def slot_occupancy(events: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Active requests and free slots at every start and end of a request.

    A sweep over marks of +1 and -1 in time order; at equal times ends come
    before starts. Its sums run over range partitions, so the length of the
    history doesn't matter. Ends without a start, or before it, are no marks.
    """
    started, ended = F.col("kind") == "start", F.col("kind") == "end"
    requests = events.groupBy("token").agg(
        F.min(F.when(started, F.col("ts"))).alias("_start"), F.max(F.when(ended, F.col("ts"))).alias("_end")
    )
    begins = F.struct(F.col("_start").alias("ts"), F.lit("start").alias("kind"), F.lit(1).cast("bigint").alias("_mark"))
    ends = F.struct(F.col("_end").alias("ts"), F.lit("end").alias("kind"), F.lit(-1).cast("bigint").alias("_mark"))
    has_end = F.col("_end") >= F.col("_start")
    marks = (
        requests.filter(F.col("_start").isNotNull())
        .select("token", F.explode(F.when(has_end, F.array(begins, ends)).otherwise(F.array(begins))).alias("_at"))
        .select("token", "_at.*")
    )
    swept = running(marks, [], ["ts", "_mark", "token"], {"active_count": F.col("_mark")}, "occupancy")
    free = F.greatest(F.lit(0), F.lit(limits.max_concurrent) - F.col("active_count"))
    return swept.select("ts", "token", "kind", "active_count", free.alias("available_slots"))


def recent_errors(errors: DataFrame, limits: Limits = DEFAULT,
                  limit: int | None = None) -> DataFrame:
    """Newest errors first. Each task keeps only its own newest ones."""
    newest = errors.orderBy(F.desc("occurred_at"), F.desc("seq"))
    return newest.limit(min(limit or limits.error_page, limits.error_history))


def processing_status(open_: DataFrame, errors: DataFrame,
                      limits: Limits = DEFAULT) -> DataFrame:
    """The one-row summary over open requests and recent errors.

    Both inputs are counted in one aggregate over their union, so no join of
    single rows is needed.
    """
    marks = open_.select(F.lit(True).alias("_open")).unionByName(
        recent_errors(errors, limits).select(F.lit(False).alias("_open"))
    )
    counts = marks.agg(
        F.count_if("_open").alias("active_count"),
        F.count_if(~F.col("_open")).alias("recent_error_count"),
    )
    free = F.greatest(F.lit(0), F.lit(limits.max_concurrent) - F.col("active_count"))
    return counts.select(
        (F.col("active_count") > 0).alias("is_processing"),
        F.lit(True).alias("accepting_requests"),
        "active_count",
        F.lit(limits.max_concurrent).alias("max_concurrent"),
        free.alias("available_slots"),
        "recent_error_count",
    )


def request_log(requests: DataFrame) -> DataFrame:
    """Finished requests with their duration. Health checks are not logged."""
    return requests.filter(F.col("path") != "/health").withColumn(
        "duration_ms", duration_ms(F.col("started_at"), F.col("ended_at"))
    )
