"""From page texts to document texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.errors import EXTRACTION_FAILED, NO_READABLE_TEXT, error, no_error
from ledgerloom.functions.text import compact, strip
from ledgerloom.limits import DEFAULT, Limits
from ledgerloom.operators.scans import numbered

# Names of the two ways a text was obtained.
DIGITAL_METHOD = "pymupdf"
OCR_METHOD = "paddleocr"


def page_header(page_no: Column) -> Column:
    return F.concat(F.lit("--- PAGE "), page_no.cast("string"), F.lit(" ---"))


def number_page_rows(rows: DataFrame, key: str, order: list) -> DataFrame:
    """Flat page rows with ``page_no`` from 1 in ``order``; a long document is numbered by many tasks."""
    return numbered(rows, [key], order, "page_no", "page-numbers").withColumn("page_no", F.col("page_no").cast("int"))


def number_pages(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """One row per element of an array of page texts, numbered from 1."""
    return (
        documents.select("*", F.posexplode(pages).alias("_pos", "text"))
        .withColumn("page_no", F.col("_pos") + 1)
        .drop("_pos", pages)
    )


def _joined(pages: Column, page_end: str) -> Column:
    """Pages in order, each below its header."""

    def render(page: Column) -> Column:
        return F.concat(page_header(page["page_no"]), F.lit("\n"), page["body"])

    return strip(F.array_join(F.transform(F.sort_array(pages), render), page_end))


def _gather(doc_pages: DataFrame, body: Column, limits: Limits) -> DataFrame:
    """One row per document with the pages of both layers, in one aggregate.

    Pages are numbered from 1 and unique per layer, so a document whose largest number
    is over the limit has too many pages. It is rejected as a whole; of no
    document are more pages gathered than the limit allows.
    """
    raw = strip(F.col("text"))
    is_ocr = F.col("layer") == "ocr"
    allowed = F.col("page_no") <= limits.max_pdf_pages
    page = F.struct(F.col("page_no").alias("page_no"), body.alias("body"))
    digital = ~is_ocr & (raw != "")
    # Length of the joined digital text: header, newline, body, blank line.
    digital_length = F.length(page_header(F.col("page_no"))) + 1 + F.length(raw) + 2
    return doc_pages.groupBy("doc_key").agg(
        F.max("page_no").alias("total_pages"),
        F.collect_list(F.when(allowed & digital, page)).alias("_digital"),
        F.collect_list(F.when(allowed & is_ocr, page)).alias("_ocr"),
        F.coalesce(F.sum(F.when(digital, digital_length)) - 2, F.lit(0)).alias("_digital_chars"),
        F.count_if(is_ocr).alias("_ocr_pages"),
        F.count_if(is_ocr & (raw == "")).alias("_blank_ocr_pages"),
    )


def _routed(gathered: DataFrame, page_end: str, limits: Limits) -> DataFrame:
    """Digital text where it is long enough, else OCR for the whole document."""
    too_many = F.col("total_pages") > limits.max_pdf_pages
    # No way is taken for a document with too many pages.
    used_ocr = F.when(~too_many, F.col("_digital_chars") < limits.min_digital_chars)
    unreadable = used_ocr & ((F.col("_ocr_pages") == 0) | (F.col("_blank_ocr_pages") > 0))
    failure = (
        F.when(
            too_many,
            error(413, "too_many_pages", f"PDF exceeds the {limits.max_pdf_pages}-page limit"),
        )
        .when(unreadable, error(422, EXTRACTION_FAILED, NO_READABLE_TEXT))
        .otherwise(no_error())
    )
    pages = F.when(used_ocr, F.col("_ocr")).otherwise(F.col("_digital"))
    return gathered.select(
        "doc_key",
        "total_pages",
        used_ocr.alias("used_ocr"),
        F.when(used_ocr, F.lit(OCR_METHOD))
        .when(~used_ocr, F.lit(DIGITAL_METHOD))
        .alias("extraction_method"),
        F.when(failure.isNull(), _joined(pages, page_end)).alias("text"),
        failure.alias("error"),
    )


def document_text(doc_pages: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Document text from ``(doc_key, page_no, layer, text)``.

    A page is unique per document and layer. Blank digital pages are dropped
    and leave a gap in the numbering; OCR pages are all kept.
    """
    gathered = _gather(doc_pages, strip(F.col("text")), limits)
    routed = _routed(gathered, "\n\n", limits)
    return routed.withColumn("character_count", F.length("text"))


def compacted_document_text(doc_pages: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Like ``document_text``, but with pages compacted before the shuffle.

    Page ends are line ends, so compacting pages and joining them equals
    compacting the joined text, and less text travels.
    """
    gathered = _gather(doc_pages, compact(F.col("text")), limits)
    return _routed(gathered, "\n", limits)


def documents_needing_ocr(pdfs: DataFrame, digital_pages: DataFrame,
                          limits: Limits = DEFAULT) -> DataFrame:
    """PDFs whose digital text is too short, for jobs that call an OCR engine."""
    raw = strip(F.col("text"))
    length = F.length(page_header(F.col("page_no"))) + 1 + F.length(raw) + 2
    readable = (
        digital_pages.filter(raw != "")
        .groupBy("doc_key")
        .agg(F.sum(length).alias("_chars"))
        .filter(F.col("_chars") - 2 >= limits.min_digital_chars)
    )
    return pdfs.join(readable, "doc_key", "left_anti")
