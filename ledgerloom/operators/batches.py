"""Batch jobs: item results, progress and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.errors import INVALID_REQUEST, error, no_error
from ledgerloom.functions.identifiers import job_key, requested_job_key
from ledgerloom.functions.times import iso_timestamp
from ledgerloom.limits import DEFAULT, Limits
from ledgerloom.operators.countries import apply_rules
from ledgerloom.operators.envelopes import json_record
from ledgerloom.operators.groups import split_by_size
from ledgerloom.operators.parse import parse_replies
from ledgerloom.schemas import COUNTRIES


def item_results(replies: DataFrame, country: str) -> DataFrame:
    """Results of one country's batch items from their model replies.

    A failing item becomes a failed row and leaves the others alone. Batch
    items get the rules that change a record, but no UAE checks. ``data`` is
    JSON text, so the three countries share one table. ``finished_at`` and
    ``seq`` of the replies, if there, are handed on.
    """
    parsed = apply_rules(parse_replies(replies, country), country)
    data = F.to_json(
        json_record(F.col("data"), COUNTRIES[country]), {"ignoreNullFields": "false"}
    )
    ok = F.col("error").isNull()
    return parsed.select(
        "batch_job_name",
        "item_no",
        "custom_id",
        F.lit(country).alias("country"),
        ok.alias("success"),
        F.when(ok, data).alias("data"),
        F.col("error.detail").alias("error"),
        "token_usage",
        *[c for c in ("finished_at", "seq") if c in parsed.columns],
    )


def progress(results: DataFrame) -> DataFrame:
    """Counts per job. Only partial counts are shuffled, so a huge job is harmless."""
    return results.groupBy("batch_job_name").agg(
        F.count_if("success").alias("completed_items"),
        F.count_if(~F.col("success")).alias("failed_items"),
        F.max("finished_at").alias("_last"),
    )


def batch_status(headers: DataFrame, results: DataFrame) -> DataFrame:
    """Status of every job, also of those without results."""
    return status_from_progress(headers, progress(results))


def status_from_progress(headers: DataFrame, counts: DataFrame) -> DataFrame:
    joined = headers.join(counts, "batch_job_name", "left")
    completed = F.coalesce("completed_items", F.lit(0))
    failed = F.coalesce("failed_items", F.lit(0))
    # A job whose items all failed is complete, too.
    state = F.when(completed + failed == F.col("total_items"), F.lit("COMPLETED")).otherwise(
        F.lit("PROCESSING")
    )
    return joined.select(
        "batch_job_name",
        state.alias("state"),
        "total_items",
        completed.alias("completed_items"),
        failed.alias("failed_items"),
        iso_timestamp(F.col("created_at")).alias("created_at"),
        iso_timestamp(F.greatest("created_at", "_last")).alias("updated_at"),
    )


def nested_results(results: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Result list per job in completion order, with ``n_results`` and ``error``.

    Jobs hold at most ``max_batch_items`` items. A job with more has no list:
    it gets an error row with its true count, and its items never meet.
    """
    entry = F.struct(
        "finished_at", "seq", "custom_id", "success", "data", "error", "token_usage"
    )
    small, large = split_by_size(results, ["batch_job_name"], limits.max_batch_items)
    nested = small.groupBy("batch_job_name").agg(
        F.sort_array(F.collect_list(entry)).alias("_entries")
    )
    kept = ("custom_id", "success", "data", "error", "token_usage")
    entries = F.transform("_entries", lambda e: F.struct(*[e[k].alias(k) for k in kept]))
    lists = nested.select(
        "batch_job_name",
        F.size("_entries").cast("bigint").alias("n_results"),
        entries.alias("results"),
        no_error().alias("error"),
    )
    detail = F.concat(
        F.lit(f"Batch job has more than {limits.max_batch_items} items: "),
        F.col("n_rows").cast("string"),
    )
    rejected = large.select(
        "batch_job_name",
        F.col("n_rows").alias("n_results"),
        F.lit(None).cast(lists.schema["results"].dataType).alias("results"),
        error(400, INVALID_REQUEST, detail).alias("error"),
    )
    return lists.unionByName(rejected)


def find_jobs(requests: DataFrame, status: DataFrame,
              name: str = "requested_name") -> tuple[DataFrame, DataFrame]:
    """Requests with their job's status, and requests for unknown jobs.

    Both are views of ``lookup_jobs``.
    """
    looked_up = lookup_jobs(requests, status, name)
    found = looked_up.filter(F.col("error").isNull()).drop("error")
    missing = looked_up.filter(F.col("error").isNotNull())
    return found, missing.select(*requests.columns, "error")


def lookup_jobs(requests: DataFrame, status: DataFrame, name: str = "requested_name") -> DataFrame:
    """Every request with its job's status, or with an ``error`` if there is none.

    Names match after stripping, with or without their prefix, and once more
    without a prefix given twice. One join, so requests are read once.
    """
    keyed = requests.withColumn("_key", requested_job_key(F.col(name)))
    known = status.withColumn("_key", job_key(F.col("batch_job_name")))
    detail = F.concat(F.lit("Batch job '"), F.col(name), F.lit("' was not found."))
    missing = F.when(
        F.col("batch_job_name").isNull(), error(404, "batch_job_not_found", detail)
    )
    return keyed.join(known, "_key", "left").drop("_key").withColumn("error", missing)
