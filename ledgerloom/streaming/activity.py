"""Open requests and errors as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ledgerloom.limits import DEFAULT, Limits
from ledgerloom.sources.sinks import complete_batches, drop_folder

_STATE = (
    "token string, request_id string, operation string, started_at timestamp, "
    "ended_at timestamp"
)


def _merge(events: DataFrame) -> DataFrame:
    """One row per request from rows that know its start, its end or both."""
    return (
        events.groupBy("token")
        .agg(
            F.max("request_id").alias("request_id"),
            F.max("operation").alias("operation"),
            F.min("started_at").alias("started_at"),
            F.max("ended_at").alias("ended_at"),
        )
        .filter(F.col("started_at").isNotNull() | F.col("ended_at").isNotNull())
    )


def _marks(events: DataFrame) -> DataFrame:
    """Events as partial request rows."""
    is_start, is_end = F.col("kind") == "start", F.col("kind") == "end"
    ts = F.col("ts").cast("timestamp")
    return events.select(
        "token",
        F.when(is_start, F.col("request_id")).alias("request_id"),
        F.when(is_start, F.col("operation")).alias("operation"),
        F.when(is_start, ts).alias("started_at"),
        F.when(is_end, ts).alias("ended_at"),
    )


def start_request_states(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Follows requests from a stream of start and end events.

    Micro-batch ``n`` merges its events with the unfinished requests of
    micro-batch ``n - 1`` and writes folder ``batch=n``, finished and
    unfinished apart. Only unfinished requests are carried on, in either order
    of start and end, and a repeated micro-batch rewrites its own folder.
    """

    def step(new: DataFrame, batch_id: int) -> None:
        rows = _marks(new)
        if batch_id > 0:
            spark = new.sparkSession
            last = f"{path}/batch={batch_id - 1}"
            before = spark.read.schema(f"{_STATE}, is_done boolean").parquet(last)
            rows = rows.unionByName(before.filter(~F.col("is_done")).drop("is_done"))
        done = F.col("started_at").isNotNull() & F.col("ended_at").isNotNull()
        _merge(rows).withColumn("is_done", done).write.mode("overwrite").partitionBy(
            "is_done"
        ).parquet(f"{path}/batch={batch_id}")

    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(step)
        .trigger(availableNow=True)
        .start()
    )


def request_states(spark: SparkSession, path: str) -> DataFrame:
    """Latest state of every request that has started."""
    rows = spark.read.schema(f"{_STATE}, is_done boolean, batch bigint").parquet(path)
    return (
        _merge(rows)
        .filter(F.col("started_at").isNotNull())
        .withColumn("is_open", F.col("ended_at").isNull())
    )


def start_request_joins(events: DataFrame, path: str, checkpoint: str, longest: str = "1 hour",
                        late: str = "10 minutes") -> StreamingQuery:
    """Requests with their end, from a stream of start and end events.

    A left outer join of the two kinds inside the state store. An end belongs
    to a start up to ``longest`` before it; events may come ``late``. A start is held until its
    end has come or can't come any more; then it leaves without one. State is bounded by
    the starts of that stretch of time, and a restart goes on from the checkpoint.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    starts = timed.filter("kind = 'start'").select("token", "request_id", "operation", F.col("ts").alias("started_at"))
    ends = timed.filter("kind = 'end'").select(F.col("token").alias("_token"), F.col("ts").alias("ended_at"))
    joined = starts.withWatermark("started_at", late).join(
        ends.withWatermark("ended_at", late),
        F.expr(f"token = _token and ended_at >= started_at and ended_at <= started_at + interval {longest}"),
        "leftOuter",
    )
    return (
        joined.drop("_token")
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def start_error_log(errors: DataFrame, path: str, checkpoint: str, limits: Limits = DEFAULT) -> StreamingQuery:
    """Keeps the newest errors of a stream, as many as the history holds.

    Micro-batch ``n`` merges its own newest rows with those kept by the batch
    before and writes folder ``batch=n``. A folder counts once it is complete, a repeated micro-batch
    rewrites its own, and all but the last two are removed: the log never grows.
    """

    def step(new: DataFrame, batch_id: int) -> None:
        rows = new
        if batch_id > 0:
            rows = rows.unionByName(new.sparkSession.read.schema(new.schema).parquet(f"{path}/batch={batch_id - 1}"))
        newest = rows.orderBy(F.desc("occurred_at"), F.desc("seq")).limit(limits.error_history)
        newest.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        drop_folder(new.sparkSession, f"{path}/batch={batch_id - 2}")

    return (
        errors.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(step)
        .trigger(availableNow=True)
        .start()
    )


def kept_errors(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest complete folder of the error log."""
    newest = max(complete_batches(spark, path))
    return spark.read.parquet(f"{path}/batch={newest}")
