import json

from pyspark.sql import functions as F

from ledgerloom.limits import Limits
from ledgerloom.operators import layout
from ledgerloom.sources import ocr


def corners(x, y, width, height):
    return [[x, y], [x + width, y], [x + width, y + height], [x, y + height]]


# Pages drawn by hand: text and (left, top, width, height) of each box, then the text of the page.
PAGES = {
    "gaps": ([("Sum", (10, 40, 30, 10)), ("7", (40, 12, 10, 10)), ("No", (10, 10, 20, 10)), ("9.50", (100, 41, 30, 10))],
             "No 7\nSum | 9.50"),
    "drift": ([("a", (0, 0, 10, 10)), ("b", (20, 6, 10, 10)), ("c", (40, 9, 10, 10)), ("d", (60, 12, 10, 10))], "a b c\nd"),
    "wide": ([("Item", (200, 0, 90, 10)), (" Qty ", (302, 0, 30, 10)), ("Price", (560, 0, 40, 10)), ("x", (470, 30, 20, 10)),
              ("y", (500, 30, 20, 10)), ("u", (470, 60, 20, 10)), ("v", (496, 60, 20, 10))], "Item | Qty | Price\nx | y\nu v"),
    "narrow": ([("Item", (100, 0, 90, 10)), ("Qty", (202, 0, 30, 10)), ("Price", (460, 0, 30, 10))], "Item Qty | Price"),
    "overlap": ([("wide", (0, 0, 100, 10)), ("in", (50, 1, 10, 10)), ("next", (118, 0, 10, 10))], "wide in next"),
    "flat": ([("p", (0, 0, 5, 0)), ("q", (17, 4, 5, 0)), ("r", (35, 4, 5, 0))], "p q | r"),
    "blank": ([("   ", (0, 0, 9, 9)), ("\u3000", (0, 20, 9, 9))], ""),
}


def test_drawn_pages(spark):
    pages, expected = [], {}
    for i, (key, (boxes, text)) in enumerate(PAGES.items()):
        texts, polygons = [t for t, _ in boxes] + ["lost"], [corners(*c) for _, c in boxes] + [[[1, 2]]]
        body = {"rec_texts": texts, "rec_polys": polygons}
        if i % 3 == 1:
            body = {"res": {"rec_text": texts, "rec_polys": [], "text_det_polys": polygons}}
        items = [[q, [t, 0.9]] for q, t in zip(polygons, texts)]
        bare = [[]] + [[q, t] for q, t in zip(polygons, texts)]
        pages.append((key, 1, json.dumps(body), json.dumps(items), json.dumps([items]), json.dumps(bare)))
        expected[key] = text
    legacy = ("plain", "wrapped", "bare")
    frame = spark.createDataFrame(pages, "doc_key string, page_no int, body string, " + ", ".join(f"{n} string" for n in legacy))
    for result in (ocr.page_texts(frame), *[ocr.legacy_page_texts(frame, n) for n in legacy]):
        assert {r.doc_key: r.text for r in result.collect()} == expected
    filled = {k: v for k, v in expected.items() if v}
    boxes = ocr.flat_boxes(frame.drop(*legacy)).repartition(7)
    assert {r.doc_key: r.text for r in layout.pages_from_boxes(boxes).collect()} == filled


def test_equal_corners_keep_detection_order(spark):
    frame = spark.createDataFrame(
        [("d", 1, i, 5.0, 5.0, right, 10.0, f"t{i}") for i, right in enumerate((90.0, 20.0, 50.0))],
        "doc_key string, page_no int, ord int, top double, left double, right double, height double, text string",
    )
    assert layout.pages_from_boxes(frame).first().text == "t0 t1 t2"


def test_mismatch_gives_plain_lines(spark):
    body = json.dumps({"rec_texts": [" a ", "", "b"], "rec_polys": [[[0, 0], [1, 1]]]})
    frame = spark.createDataFrame([("d", body)], "doc_key string, body string")
    assert ocr.page_texts(frame).first().text == "a\nb"


def test_crowded_page_gets_an_error_instead_of_a_huge_group(spark):
    limits = Limits(max_input_tokens=10)
    boxes = spark.range(0, 1000).selectExpr(
        "case when id < 5 then 'small' else 'crowded' end as doc_key", "1 as page_no",
        "cast(case when id < 5 then id else id - 5 end as int) as ord", "cast(id as double) as top",
        "0D as left", "9D as right", "10D as height", "'x' as text",
    )
    rows = {r.doc_key: r for r in layout.pages_from_boxes(boxes, limits).collect()}
    assert rows["small"].text == "x x x x x" and rows["small"].error is None
    assert rows["crowded"].text is None and rows["crowded"].error.status == 422
    assert rows["crowded"].box_count == 995
    # Gaps in the numbering lose nothing.
    gaps = boxes.filter("doc_key = 'small'").withColumn("ord", F.col("ord") * 1000)
    assert [(r.text, r.box_count) for r in layout.pages_from_boxes(gaps, limits).collect()] == [("x x x x x", 5)]


def test_blank_page_is_reported(spark):
    frame = spark.createDataFrame(
        [("d", 1, 0, 0.0, 0.0, 1.0, 1.0, "  ")],
        "doc_key string, page_no int, ord int, top double, left double, right double, height double, text string",
    )
    assert layout.pages_from_boxes(frame).select(F.col("error.status")).first()[0] == 422
