"""Page text from a flat table of OCR boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.errors import (
    EXTRACTION_FAILED,
    NO_READABLE_TEXT,
    TEXT_TOO_LONG,
    error,
    no_error,
)
from ledgerloom.functions.layout import render_boxes
from ledgerloom.functions.text import strip
from ledgerloom.limits import DEFAULT, Limits
from ledgerloom.operators.groups import split_by_size

PAGE_KEYS = ["doc_key", "page_no"]


def _box():
    return F.struct(
        "top",
        "left",
        F.col("ord").cast("int").alias("ord"),
        "right",
        "height",
        strip(F.col("text")).alias("text"),
    )


def _rendered(pages: DataFrame, too_many) -> DataFrame:
    failure = (
        F.when(too_many, error(422, EXTRACTION_FAILED, TEXT_TOO_LONG))
        .when(F.col("box_count") == 0, error(422, EXTRACTION_FAILED, NO_READABLE_TEXT))
        .otherwise(no_error())
    )
    checked = pages.withColumn("error", failure)
    text = F.when(F.col("error").isNull(), render_boxes(F.col("_boxes")))
    return checked.select(*PAGE_KEYS, "box_count", text.alias("text"), "error")


def pages_from_boxes(boxes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """One row per page from boxes ``(doc_key, page_no, ord, top, ..., text)``.

    A page with more boxes than the token ceiling can hold cannot pass it
    whatever its boxes say. It gets that error with its true count, and its
    boxes never meet in one task. Blank boxes are not counted.
    """
    keep = strip(F.col("text")) != ""
    # A blank box stands for its page only, and says nothing about its size.
    _, large = split_by_size(boxes.filter(keep), PAGE_KEYS, limits.max_page_boxes)
    crowded = large.select(*[F.col(k).alias(f"_{k}") for k in PAGE_KEYS])
    same = F.lit(True)
    for key in PAGE_KEYS:
        same = same & boxes[key].eqNullSafe(crowded[f"_{key}"])
    pages = (
        boxes.join(crowded, same, "left_anti")
        .groupBy(*PAGE_KEYS)
        .agg(
            F.collect_list(F.when(keep, _box())).alias("_boxes"),
            F.count_if(keep).alias("box_count"),
        )
    )
    others = large.select(
        *PAGE_KEYS,
        F.lit(None).cast(pages.schema["_boxes"].dataType).alias("_boxes"),
        F.col("n_rows").alias("box_count"),
    )
    return _rendered(pages.unionByName(others), F.col("box_count") > limits.max_page_boxes)
