"""Reading order of OCR boxes, as expressions over one page's array of boxes.

A page is one array value, so rebuilding its rows needs no shuffle; pages are
processed in parallel. A box is ``struct<top,left,ord,right,height,text>``
where ``ord`` is its position in the detection output; sorting boxes therefore
keeps detection order among equal corners.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import strip

# Alignment rules of the row builder.
MIN_ROW_TOLERANCE = 4.0
ROW_TOLERANCE_HEIGHTS = 0.65
MIN_COLUMN_GAP = 12.0
COLUMN_GAP_HEIGHTS = 2.0
WIDE_PAGE = 500.0
FAR_RIGHT_SHARE = 0.77
FAR_RIGHT_GAP_HEIGHTS = 0.75
CELL_SEPARATOR = " | "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Lambdas evaluate captured expressions per element, and the optimizer may
    inline a projected column into them; a lambda variable stays a value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def box_from_polygon(polygon: Column, text: Column, ord_: Column) -> Column:
    """Bounding box of a polygon, null for blank text or too few coordinates."""
    coordinates = F.aggregate(polygon, F.lit(0), lambda n, p: n + F.size(p))
    clean = strip(text)

    def box(axes: Column) -> Column:
        xs, ys = axes["xs"], axes["ys"]
        return F.struct(
            F.array_min(ys).alias("top"),
            F.array_min(xs).alias("left"),
            ord_.cast("int").alias("ord"),
            F.array_max(xs).alias("right"),
            F.greatest(F.lit(1.0), F.array_max(ys) - F.array_min(ys)).alias("height"),
            clean.alias("text"),
        )

    axes = F.struct(
        F.transform(polygon, lambda p: F.get(p, F.lit(0))).alias("xs"),
        F.transform(polygon, lambda p: F.get(p, F.lit(1))).alias("ys"),
    )
    return F.when((clean != "") & (coordinates >= 4), let(axes, box))


def median_height(boxes: Column) -> Column:
    def middle(heights: Column) -> Column:
        n = F.size(heights)
        low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
        return (F.get(heights, low) + F.get(heights, high)) / 2

    return let(F.sort_array(F.transform(boxes, lambda b: b["height"])), middle)


def _row_starts(ordered: Column, tolerance: Column) -> Column:
    """Positions where a new row opens, for boxes in (top, left) order.

    A box joins the open row while its top is near the mean top of that row,
    and the mean moves with every box, so this is a fold. Sums are compensated
    to make the mean independent of rounding in long rows.
    """
    start = F.struct(
        F.lit(0.0).alias("sum"),
        F.lit(0.0).alias("rest"),
        F.lit(0).alias("n"),
        F.lit(0).alias("seen"),
        F.array().cast("array<int>").alias("starts"),
    )

    def merge(row: Column, box: Column) -> Column:
        top = box["top"]
        joins = (row["n"] > 0) & (
            F.abs(top - (row["sum"] + row["rest"]) / row["n"]) <= tolerance
        )
        total = row["sum"] + top
        lost = F.when(
            F.abs(row["sum"]) >= F.abs(top), (row["sum"] - total) + top
        ).otherwise((top - total) + row["sum"])
        return F.struct(
            F.when(joins, total).otherwise(top).alias("sum"),
            F.when(joins, row["rest"] + lost).otherwise(F.lit(0.0)).alias("rest"),
            F.when(joins, row["n"] + 1).otherwise(F.lit(1)).alias("n"),
            (row["seen"] + 1).alias("seen"),
            F.when(joins, row["starts"])
            .otherwise(F.concat(row["starts"], F.array(row["seen"])))
            .alias("starts"),
        )

    return F.aggregate(ordered, start, merge, lambda row: row["starts"])


def _row_text(row: Column, height: Column, page_right: Column) -> Column:
    """Boxes of one row from left to right, cells apart by a bar."""
    by_left = F.sort_array(
        F.transform(
            row,
            lambda b, i: F.struct(
                b["left"].alias("left"),
                i.alias("i"),
                b["right"].alias("right"),
                b["text"].alias("text"),
            ),
        )
    )
    start = F.struct(
        F.lit(None).cast("double").alias("left"),
        F.lit(None).cast("double").alias("right"),
        F.lit("").alias("text"),
    )
    wide = page_right >= WIDE_PAGE
    middle = page_right * 0.5

    def merge(done: Column, box: Column) -> Column:
        gap = box["left"] - done["right"]
        other_half = (
            wide & (done["left"] < middle) & (box["left"] >= middle) & (gap > height)
        )
        last_column = (
            wide
            & (box["left"] >= page_right * FAR_RIGHT_SHARE)
            & (gap > height * FAR_RIGHT_GAP_HEIGHTS)
        )
        wide_gap = gap > F.greatest(F.lit(MIN_COLUMN_GAP), height * COLUMN_GAP_HEIGHTS)
        separator = (
            F.when(done["left"].isNull(), F.lit(""))
            .when(wide_gap | other_half | last_column, F.lit(CELL_SEPARATOR))
            .otherwise(F.lit(" "))
        )
        return F.struct(
            box["left"].alias("left"),
            F.greatest(done["right"], box["right"]).alias("right"),
            F.concat(done["text"], separator, box["text"]).alias("text"),
        )

    return F.aggregate(by_left, start, merge, lambda done: done["text"])


def render_rows(boxes: Column) -> Column:
    """Text of each row of a page, top to bottom, as an array."""

    def with_page(page: Column) -> Column:
        ordered, height, right = page["ordered"], page["height"], page["right"]
        tolerance = F.greatest(F.lit(MIN_ROW_TOLERANCE), height * ROW_TOLERANCE_HEIGHTS)

        def with_starts(starts: Column) -> Column:
            def one_row(begin: Column, i: Column) -> Column:
                end = F.coalesce(F.get(starts, i + 1), F.size(ordered))
                return _row_text(F.slice(ordered, begin + 1, end - begin), height, right)

            return F.transform(starts, one_row)

        return let(_row_starts(ordered, tolerance), with_starts)

    page = F.struct(
        F.sort_array(boxes).alias("ordered"),
        median_height(boxes).alias("height"),
        F.array_max(F.transform(boxes, lambda b: b["right"])).alias("right"),
    )
    return F.when(F.size(boxes) > 0, let(page, with_page)).otherwise(
        F.array().cast("array<string>")
    )


def render_boxes(boxes: Column) -> Column:
    return F.array_join(render_rows(boxes), "\n")


def plain_lines(texts: Column) -> Column:
    """Non-blank texts one per line, for results whose geometry is unusable."""
    return F.array_join(F.filter(F.transform(texts, strip), lambda t: t != ""), "\n")
