"""Format detection and upload checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.errors import error, no_error
from ledgerloom.limits import DEFAULT, Limits

# The first bytes of the accepted formats.
SIGNATURES = {
    "pdf": "255044462D",
    "png": "89504E470D0A1A0A",
    "jpeg": "FFD8FF",
}


def detect_kind(content: Column) -> Column:
    """``pdf``, ``png`` or ``jpeg`` from the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, signature in SIGNATURES.items():
        kind = kind.when(head.startswith(signature), F.lit(name))
    return kind


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height from a PNG header."""

    def number(position: int) -> Column:
        return F.conv(F.hex(F.substring(content, position, 4)), 16, 10).cast("bigint")

    return number(17), number(21)


def with_png_size(uploads: DataFrame) -> DataFrame:
    """Fills width and height of PNG rows that ingest left empty."""
    width, height = png_size(F.col("content"))
    is_png = detect_kind(F.col("content")) == "png"
    return uploads.withColumns(
        {
            "width": F.coalesce(F.col("width"), F.when(is_png, width)),
            "height": F.coalesce(F.col("height"), F.when(is_png, height)),
        }
    )


def upload_error(kind: Column, limits: Limits = DEFAULT) -> Column:
    """First failing check of an upload, null when it passes.

    Reads ``length`` and the facts ingest delivers: ``opens, needs_pass,
    page_count`` of PDFs, ``decoded_format, width, height`` of images (no
    format: not decodable).
    """
    is_pdf = kind == "pdf"
    is_image = kind.isin("png", "jpeg")
    pixels = F.col("width").cast("bigint") * F.col("height").cast("bigint")
    # Codes and messages of the upload checks.
    checks = [
        (
            F.col("length") > limits.max_upload_bytes,
            error(413, "file_too_large", f"Upload exceeds the {limits.max_upload_mb} MB limit"),
        ),
        (F.col("length") == 0, error(400, "empty_file", "The uploaded file is empty")),
        (
            kind.isNull(),
            error(
                415,
                "unsupported_file_type",
                "Only genuine PDF, JPG, JPEG, and PNG files are supported",
            ),
        ),
        (
            is_pdf & ~F.coalesce(F.col("opens"), F.lit(False)),
            error(400, "invalid_pdf", "The PDF is corrupted"),
        ),
        (
            is_pdf & F.col("needs_pass"),
            error(400, "encrypted_pdf", "Password-protected PDFs are not supported"),
        ),
        (is_pdf & (F.col("page_count") < 1), error(400, "empty_pdf", "The PDF has no pages")),
        (
            is_pdf & (F.col("page_count") > limits.max_pdf_pages),
            error(413, "too_many_pages", f"PDF exceeds the {limits.max_pdf_pages}-page limit"),
        ),
        (
            is_image & F.col("decoded_format").isNull(),
            error(400, "invalid_image", "The image is corrupted"),
        ),
        (
            is_image & (F.upper("decoded_format") != F.upper(kind)),
            error(
                415,
                "spoofed_file_type",
                "The decoded image format does not match its file signature",
            ),
        ),
        (
            is_image & (pixels > limits.max_image_pixels),
            error(
                413, "image_too_large", "Image dimensions exceed the configured pixel limit"
            ),
        ),
    ]
    return F.coalesce(*[F.when(failed, problem) for failed, problem in checks], no_error())


def check_uploads(uploads: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Adds ``kind``, ``total_pages`` and ``error``; content is not needed after."""
    checked = uploads.withColumn("kind", detect_kind(F.col("content")))
    failure = upload_error(F.col("kind"), limits)
    pages = F.when(F.col("kind") == "pdf", F.col("page_count")).otherwise(F.lit(1))
    return checked.withColumn("error", failure).withColumn(
        "total_pages", F.when(F.col("error").isNull(), pages.cast("int"))
    )
