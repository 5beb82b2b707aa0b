"""From page texts and model replies to invoice tables.

Two tables are written on the way: the prepared texts, which the model reads,
and the replies next to their texts, split by country. Later stages restart
from them, so losing executors repeats one stage only and no branch computes
an earlier stage again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.errors import EXTRACTION_FAILED, NO_READABLE_TEXT, error
from ledgerloom.limits import DEFAULT, Limits
from ledgerloom.operators import uae
from ledgerloom.operators.countries import apply_rules, is_known_country, unknown_country
from ledgerloom.operators.envelopes import error_rows, success_envelopes
from ledgerloom.operators.parse import parse_replies
from ledgerloom.operators.prepare import prepare_pages
from ledgerloom.schemas import COUNTRIES
from ledgerloom.sources.sinks import write_table

_ERROR_KEYS = ["occurred_at", "seq", "request_id", "error"]


def prepare(uploads: DataFrame, doc_pages: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Checked uploads and their pages to ``prepared_text``.

    A failed upload keeps its own error and none of its pages is used. The
    page count is the file's, which blank trailing pages do not lower.
    """
    texts = prepare_pages(doc_pages, limits).withColumnsRenamed(
        {"error": "_text_error", "total_pages": "_last_page"}
    )
    joined = uploads.drop("content").join(texts, "doc_key", "left")
    no_pages = F.when(
        F.col("character_stored").isNull(), error(422, EXTRACTION_FAILED, NO_READABLE_TEXT)
    )
    failure = F.coalesce(F.col("error"), F.col("_text_error"), no_pages)
    return joined.withColumns(
        {
            "error": failure,
            "total_pages": F.coalesce("total_pages", "_last_page"),
            "character_stored": F.when(failure.isNull(), F.col("character_stored")),
        }
    ).drop("_text_error", "_last_page")


def save_replied(prepared: DataFrame, responses: DataFrame, path: str) -> DataFrame:
    """Writes texts with their replies once, a folder per country, and reads them back.

    Documents that failed before have no reply and keep their error.
    """
    write_table(prepared.join(responses, "doc_key", "left"), path, ("country",), "overwrite")
    return prepared.sparkSession.read.parquet(path)


def _has_reply(replied: DataFrame) -> Column:
    """True where the model was called, with or without success."""
    called = F.col("http_status").isNotNull()
    return called | F.col("failure").isNotNull() if "failure" in replied.columns else called


def _own(replied: DataFrame, country: str) -> DataFrame:
    fits = (F.col("country") == country) & F.col("error").isNull()
    return replied.filter(fits & _has_reply(replied))


def pending(replied: DataFrame) -> DataFrame:
    """Documents of the known countries that wait for their model call."""
    waits = F.col("error").isNull() & is_known_country(F.col("country"))
    return replied.filter(waits & ~_has_reply(replied))


def invoices(replied: DataFrame, country: str) -> DataFrame:
    """Typed invoices of one country with ``data``, ``error`` and, for the UAE,
    ``validation``. Reads that country's folder only and shuffles nothing.
    """
    ruled = apply_rules(parse_replies(_own(replied, country), country), country)
    return uae.validate(ruled) if country == "uae" else ruled


def all_envelopes(replied: DataFrame) -> dict[str, DataFrame]:
    """Success envelopes per country; the record types differ."""
    return {c: success_envelopes(invoices(replied, c), c) for c in COUNTRIES}


def all_errors(replied: DataFrame) -> DataFrame:
    """Error rows of every stage. Needs ``occurred_at, seq, request_id``.

    With the success envelopes and ``pending`` they account for every document:
    one of a missing or unknown country is an error, too.
    """
    unknown = F.when(~is_known_country(F.col("country")), unknown_country(F.col("country")))
    early = replied.withColumn("error", F.coalesce(F.col("error"), unknown))
    failed = early.filter(F.col("error").isNotNull()).select(*_ERROR_KEYS)
    for country in COUNTRIES:
        replies = parse_replies(_own(replied, country), country)
        failed = failed.unionByName(replies.select(*_ERROR_KEYS))
    return error_rows(failed)
