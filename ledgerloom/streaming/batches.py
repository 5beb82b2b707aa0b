"""Batch jobs as streams: payload files in, item results and progress out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ledgerloom.operators.batches import item_results, progress, status_from_progress
from ledgerloom.operators.countries import is_known_country, unknown_country
from ledgerloom.schemas import COUNTRIES
from ledgerloom.session import new_work_path
from ledgerloom.sources.hooks import ModelCall, run_model
from ledgerloom.sources.payloads import check_payloads, payload_items, stream_payloads
from ledgerloom.sources.sinks import complete_batches

_KEYS = ("batch_job_name", "item_no", "custom_id")


def results_of_items(items: DataFrame, factory: Callable[[], ModelCall],
                     prompts: dict[str, str], **calling) -> DataFrame:
    """Calls the model for every item and turns the replies into result rows.

    Works on batch and streaming tables alike. The country filter stands
    before the call, so each item is sent once. ``finished_at`` is taken when an
    item's own call ends, so lists come out in completion order, not in the
    order of submission. ``calling`` goes to ``run_model``.
    """
    parts = []
    for country in COUNTRIES:
        own = items.filter(F.col("country") == country)
        replies = run_model(own, factory, prompts, keys=_KEYS, **calling)
        parts.append(item_results(replies, country))
    # An item of another country fails like any other, so its job still ends.
    country = F.col("country")
    results = items.filter(~is_known_country(country)).select(
        *_KEYS,
        country,
        F.lit(False).alias("success"),
        F.lit(None).cast("string").alias("data"),
        unknown_country(country)["detail"].alias("error"),
        F.lit(None).cast(parts[0].schema["token_usage"].dataType).alias("token_usage"),
        F.current_timestamp().alias("finished_at"),
        F.col("item_no").cast("bigint").alias("seq"),
    )
    for part in parts:
        results = results.unionByName(part)
    return results


def start_batches(spark: SparkSession, payload_folder: str, results_path: str,
                  checkpoint: str, factory: Callable[[], ModelCall],
                  prompts: dict[str, str], files_per_trigger: int | None = None,
                  lines: bool = False, **calling) -> StreamingQuery:
    """Processes arriving payload files; stops after those present are done.

    A run that dies goes on from ``checkpoint``: the micro-batch it was in is
    repeated, and of its results only those of the finished attempt are in the
    sink's own list of files, so ``results_so_far`` has each item once.
    """
    arriving = stream_payloads(spark, payload_folder, lines, files_per_trigger)
    items = payload_items(check_payloads(arriving))
    return (
        results_of_items(items, factory, prompts, **calling)
        .writeStream.format("parquet")
        .option("path", results_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def results_so_far(spark: SparkSession, results_path: str) -> DataFrame:
    """Results of the finished micro-batches, also while a job is still running."""
    return spark.read.parquet(results_path)


def _newest(counts: DataFrame) -> DataFrame:
    """One row per job. Counts only grow, so the largest are the newest."""
    return counts.groupBy("batch_job_name").agg(
        *[F.max(c).alias(c) for c in ("completed_items", "failed_items", "_last")]
    )


def start_progress(results: DataFrame, progress_path: str, checkpoint: str, every: int = 10) -> StreamingQuery:
    """Running counts per job from a stream of results.

    The state is one small row per job. Each micro-batch writes the jobs that
    changed to its own folder below ``changes``, so a repeated micro-batch replaces its output. Each
    ``every``-th also writes all jobs so far below ``snapshots``, from the last
    snapshot and the changes since; older folders are never read again.
    """

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{progress_path}/changes/batch={batch_id}")
        if (batch_id + 1) % every == 0:
            so_far = latest_progress(changed.sparkSession, progress_path, batch_id)
            so_far.write.mode("overwrite").parquet(f"{progress_path}/snapshots/batch={batch_id}")

    return (
        progress(results)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def progress_folders(spark: SparkSession, progress_path: str, before: int | None = None) -> list[str]:
    """The folders that hold the state: the newest snapshot and the changes after it, ``every`` at most.

    ``before`` leaves out the snapshots from that micro-batch on, which one that is repeated has written.
    """
    snapshots = [n for n in complete_batches(spark, f"{progress_path}/snapshots") if before is None or n < before]
    last = max(snapshots, default=-1)
    changes = [n for n in complete_batches(spark, f"{progress_path}/changes") if n > last]
    return [f"{progress_path}/snapshots/batch={last}"] * (last >= 0) + [f"{progress_path}/changes/batch={n}" for n in changes]


def latest_progress(spark: SparkSession, progress_path: str, before: int | None = None) -> DataFrame:
    """Newest counts per job."""
    return _newest(spark.read.parquet(*progress_folders(spark, progress_path, before)))


def live_status(spark: SparkSession, headers: DataFrame, progress_path: str) -> DataFrame:
    return status_from_progress(headers, latest_progress(spark, progress_path))


def replay_status(spark: SparkSession, headers: DataFrame, results: DataFrame) -> DataFrame:
    """Runs a finite stream of results to its end and reports the jobs' status."""
    path = new_work_path(spark, "progress")
    checkpoint = new_work_path(spark, "progress-checkpoint")
    start_progress(results, path, checkpoint).awaitTermination()
    return live_status(spark, headers, path)
