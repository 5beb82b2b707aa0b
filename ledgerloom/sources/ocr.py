"""OCR results as a source: JSON bodies, one row per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.layout import box_from_polygon, let, plain_lines, render_boxes
from ledgerloom.functions.text import strip

_POLYGONS = "array<array<array<double>>>"
_FIELDS = (
    "rec_text array<string>, rec_texts array<string>, "
    f"text_det_polys {_POLYGONS}, rec_polys {_POLYGONS}"
)
_RESULT = f"{_FIELDS}, res struct<{_FIELDS.replace(' array', ':array')}>"


def _first_filled(first: Column, second: Column) -> Column:
    return F.when(F.size(first) > 0, first).otherwise(second)


def _boxes(texts: Column, polygons: Column) -> Column:
    pairs = F.arrays_zip(texts.alias("text"), polygons.alias("polygon"))
    boxes = F.transform(pairs, lambda p, i: box_from_polygon(p["polygon"], p["text"], i))
    return F.filter(boxes, lambda b: b.isNotNull())


def read_results(ocr_results: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``texts``, ``polygons`` and ``boxes`` parsed from a result body."""
    with_result = ocr_results.withColumn("_result", F.from_json(F.col(body), _RESULT))

    def pick(name: str) -> Column:
        has_wrapper = F.col("_result.res").isNotNull()
        return F.when(has_wrapper, F.col(f"_result.res.{name}")).otherwise(
            F.col(f"_result.{name}")
        )

    picked = with_result.withColumns(
        {
            "texts": _first_filled(pick("rec_text"), pick("rec_texts")),
            "polygons": _first_filled(pick("text_det_polys"), pick("rec_polys")),
        }
    ).drop("_result")
    usable = F.size("texts") == F.size("polygons")
    return picked.withColumn(
        "boxes", F.when(usable, _boxes(F.col("texts"), F.col("polygons")))
    )


def page_texts(ocr_results: DataFrame, body: str = "body") -> DataFrame:
    """Page text of each result: rows from geometry, plain lines without it."""
    parsed = read_results(ocr_results, body)
    text = F.when(F.col("boxes").isNotNull(), render_boxes(F.col("boxes"))).otherwise(
        F.coalesce(plain_lines(F.col("texts")), F.lit(""))
    )
    return parsed.withColumn("text", strip(text)).drop("texts", "polygons", "boxes")


def flat_boxes(ocr_results: DataFrame, body: str = "body") -> DataFrame:
    """One row per box, for jobs that keep boxes as a table."""
    parsed = read_results(ocr_results, body)
    return (
        parsed.drop("texts", "polygons", body)
        # The outer form keeps the optimizer from filtering on the array, which
        # would parse every body again below the parse.
        .withColumn("box", F.explode_outer("boxes"))
        .filter(F.col("box").isNotNull())
        .select("*", "box.*")
        .drop("boxes", "box")
    )


def legacy_page_texts(ocr_results: DataFrame, body: str = "body") -> DataFrame:
    """Page text from the older ``[[polygon, [text, score]], ...]`` bodies.

    The list may be wrapped once more. Items with fewer than two parts are
    skipped.
    """

    def items_of(value: Column) -> Column:
        # An item starts with its polygon, so three steps down stands a number;
        # in a list that is wrapped once more, a point stands there.
        outer = F.try_variant_get(value, "$", "array<variant>")
        is_unwrapped = F.exists(
            outer, lambda item: F.try_variant_get(item, "$[0][0][0]", "double").isNotNull()
        )
        return F.when(is_unwrapped, outer).otherwise(
            F.try_variant_get(value, "$[0]", "array<variant>")
        )

    def box_of(item: Column, i: Column) -> Column:
        text = F.coalesce(
            F.try_variant_get(item, "$[1][0]", "string"),
            F.try_variant_get(item, "$[1]", "string"),
        )
        polygon = F.try_variant_get(item, "$[0]", "array<array<double>>")
        return let(
            F.struct(polygon.alias("polygon"), text.alias("text")),
            lambda part: box_from_polygon(part["polygon"], part["text"], i),
        )

    boxes = let(
        F.try_parse_json(F.col(body)),
        lambda v: F.filter(F.transform(items_of(v), box_of), lambda b: b.isNotNull()),
    )
    with_boxes = ocr_results.withColumn("boxes", boxes)
    text = F.coalesce(render_boxes(F.col("boxes")), F.lit(""))
    return with_boxes.withColumn("text", strip(text)).drop("boxes")
