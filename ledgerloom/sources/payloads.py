"""Batch payloads: JSON files with a list of prepared texts each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.errors import INVALID_REQUEST, error, no_error, validation_detail
from ledgerloom.functions.identifiers import job_name
from ledgerloom.limits import DEFAULT, Limits
from ledgerloom.schemas import BATCH_PAYLOAD_SQL


_BROKEN = "_broken"
_READ_SQL = f"{BATCH_PAYLOAD_SQL}, {_BROKEN} string"


def _reader_options(lines: bool) -> dict[str, object]:
    return {"multiLine": not lines, "columnNameOfCorruptRecord": _BROKEN}


def read_payloads(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Payload files below a folder, one body each or, with ``lines``, one per line.

    A body that is no JSON is a row with its text in ``_broken``; ``source``
    names the file. Without ``lines`` a file is one task's work, as a request
    body is; files of lines are split.
    """
    return (
        spark.read.schema(_READ_SQL)
        .options(**_reader_options(lines))
        .option("recursiveFileLookup", True)
        .json(folder)
        .withColumn("source", F.col("_metadata.file_path"))
    )


def stream_payloads(spark: SparkSession, folder: str, lines: bool = False,
                    files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(_READ_SQL).options(**_reader_options(lines))
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder).withColumn("source", F.col("_metadata.file_path"))


def check_payloads(payloads: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Names unnamed jobs, counts their items and adds ``error``.

    A payload needs 1 to 100 items, each with a text; an empty text is fine.
    A body that was no JSON is rejected and keeps no name.
    """
    broken = F.col(_BROKEN).isNotNull() if _BROKEN in payloads.columns else F.lit(False)
    size = F.coalesce(F.size("items"), F.lit(-1))
    problem_sql = "array<struct<loc:array<string>,msg:string>>"

    def problem(loc, msg):
        return F.array(F.struct(F.array(*loc).alias("loc"), msg.alias("msg"))).cast(problem_sql)

    items_loc = (F.lit("body"), F.lit("items"))
    numbered = F.transform(
        "items",
        lambda item, i: F.struct(
            F.array(*items_loc, i.cast("string"), F.lit("text")).alias("loc"),
            F.when(F.coalesce(item["text"], item["character_stored"]).isNull(),
                   F.lit("Field required")).alias("msg"),
        ),
    )
    # Messages of the request checks.
    problems = (
        F.when(broken, problem((F.lit("body"),), F.lit("JSON decode error")))
        .when(size == -1, problem(items_loc, F.lit("Field required")))
        .when(
            size == 0,
            problem(items_loc, F.lit("List should have at least 1 item after validation, not 0")),
        )
        .when(
            size > limits.max_batch_items,
            problem(
                items_loc,
                F.concat(
                    F.lit(
                        f"List should have at most {limits.max_batch_items} items"
                        " after validation, not "
                    ),
                    size.cast("string"),
                ),
            ),
        )
        .otherwise(F.filter(numbered, lambda p: p["msg"].isNotNull()).cast(problem_sql))
    )
    named = F.when(
        ~broken, F.coalesce("batch_job_name", job_name(F.col("created_at"), F.to_json("items")))
    )
    checked = payloads.withColumns(
        {"batch_job_name": named, "total_items": F.greatest(size, F.lit(0)), "_problems": problems}
    )
    failure = F.when(
        F.size("_problems") > 0, error(400, INVALID_REQUEST, validation_detail(F.col("_problems")))
    ).otherwise(no_error())
    return checked.withColumn("error", failure).drop("_problems", _BROKEN)


def job_headers(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error").isNull()).select(
        "batch_job_name", "total_items", "created_at"
    )


def payload_items(checked: DataFrame) -> DataFrame:
    """One row per item of the accepted payloads. Short names win over long ones."""
    return (
        checked.filter(F.col("error").isNull())
        .select("batch_job_name", "country", F.posexplode("items").alias("item_no", "_item"))
        .select(
            "batch_job_name",
            "country",
            "item_no",
            F.coalesce("_item.id", "_item.custom_id").alias("custom_id"),
            F.coalesce("_item.text", "_item.character_stored").alias("character_stored"),
        )
    )
