from pyspark.sql import functions as F

from ledgerloom.limits import Limits
from ledgerloom.operators import file_checks, india, pages, prepare
from ledgerloom.sources import files, hooks

HEADS = {"pdf": b"%PDF-1.7", "png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff\xe0", "html": b"<html>", "short": b"%PDF"}
FACTS = ("name string, content binary, length bigint, opens boolean, needs_pass boolean, page_count int, "
         "decoded_format string, width int, height int")


def upload(name, kind="pdf", length=100, opens=True, needs_pass=False, page_count=1, fmt=None, width=1, height=1):
    return (name, HEADS[kind], length, opens, needs_pass, page_count, fmt, width, height)


def test_upload_checks(spark):
    limit = 15 * 1024 * 1024
    cases = {
        "ok": (upload("ok"), None),
        "exact": (upload("exact", length=limit), None),
        "large": (upload("large", "html", length=limit + 1), "file_too_large"),
        "empty": (upload("empty", "html", length=0), "empty_file"),
        "html": (upload("html", "html"), "unsupported_file_type"),
        "short": (upload("short", "short"), "unsupported_file_type"),
        "broken": (upload("broken", opens=False), "invalid_pdf"),
        "locked": (upload("locked", needs_pass=True, page_count=0), "encrypted_pdf"),
        "none": (upload("none", page_count=0), "empty_pdf"),
        "twenty": (upload("twenty", page_count=20), None),
        "many": (upload("many", page_count=21), "too_many_pages"),
        "png": (upload("png", "png", fmt="PNG", width=8000, height=5000), None),
        "big": (upload("big", "png", fmt="PNG", width=8000, height=5001), "image_too_large"),
        "huge": (upload("huge", "png", fmt="PNG", width=2_000_000, height=2_000_000), "image_too_large"),
        "fake": (upload("fake", "jpeg", fmt="PNG"), "spoofed_file_type"),
        "bad": (upload("bad", "jpeg"), "invalid_image"),
    }
    frame = spark.createDataFrame([c[0] for c in cases.values()], FACTS)
    got = {r.name: r for r in file_checks.check_uploads(frame).collect()}
    assert {n: (r.error.code if r.error else None) for n, r in got.items()} == {n: c[1] for n, c in cases.items()}
    assert got["twenty"].total_pages == 20 and got["png"].total_pages == 1 and got["many"].total_pages is None


def test_png_size_from_header(spark):
    header = HEADS["png"] + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (70000).to_bytes(4, "big")
    frame = spark.createDataFrame([(bytearray(header), None, None)], "content binary, width int, height int")
    row = file_checks.with_png_size(frame).first()
    assert (row.width, row.height) == (640, 70000)


def test_files_are_read_by_content_and_split_by_size(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "wrong.txt").write_bytes(HEADS["pdf"])
    (tmp_path / "big.pdf").write_bytes(b"x" * (1024 * 1024 + 1))
    uploads = files.read_uploads(spark, str(tmp_path))
    small, oversize = files.split_by_size(uploads, Limits(max_upload_mb=1))
    assert [r.kind for r in small.select(file_checks.detect_kind(F.col("content")).alias("kind")).collect()] == ["pdf"]
    assert oversize.count() == 1 and "content" not in oversize.columns
    plan = oversize._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,1048576)" in plan.replace(" ", "")


PAGE = "doc_key string, page_no int, layer string, text string"


def test_routing_threshold_counts_headers(spark):
    header = len("--- PAGE 1 ---\n")
    rows = [
        ("d39", 1, "digital", "x" * (39 - header)), ("d39", 1, "ocr", "scanned"),
        ("d40", 1, "digital", "x" * (40 - header)), ("d40", 1, "ocr", "scanned"),
        ("gap", 1, "digital", "first page text"), ("gap", 2, "digital", " \n"), ("gap", 3, "digital", " third "),
        ("none", 1, "digital", ""), ("blank", 1, "ocr", "seen"), ("blank", 2, "ocr", "  "),
    ]
    frame = spark.createDataFrame(rows, PAGE).repartition(5)
    got = {r.doc_key: r for r in pages.document_text(frame).collect()}
    assert got["d39"].text == "--- PAGE 1 ---\nscanned" and got["d39"].used_ocr
    assert got["d40"].character_count == 40 and not got["d40"].used_ocr
    assert got["gap"].text == "--- PAGE 1 ---\nfirst page text\n\n--- PAGE 3 ---\nthird"
    assert got["gap"].total_pages == 3
    assert got["none"].error.code == got["blank"].error.code == "document_extraction_failed"
    needing = pages.documents_needing_ocr(frame.select("doc_key").distinct(), frame.filter("layer = 'digital'"))
    assert {r.doc_key for r in needing.collect()} == {"d39", "none", "blank"}


def test_endless_document_is_rejected_without_gathering_its_pages(spark):
    frame = spark.range(0, 5000).selectExpr(
        "case when id < 20 then 'ok' else 'hot' end as doc_key",
        "cast(case when id < 20 then id else id - 20 end as int) + 1 as page_no", "'digital' as layer",
        "'page text ' || id as text",
    )
    gathered = pages._gather(frame, F.col("text"), Limits())
    assert gathered.select(F.max(F.size("_digital"))).first()[0] == 20
    got = {r.doc_key: r for r in pages.document_text(frame).collect()}
    assert got["ok"].error is None and got["ok"].text.count("--- PAGE") == 20
    assert got["hot"].error.code == "too_many_pages" and got["hot"].text is None


def test_page_numbers_count_not_rows(spark):
    rows = [("gap", 1, "digital", "first page with enough characters"), ("gap", 30, "digital", "last"), ("edge", 20, "ocr", "seen")]
    got = {r.doc_key: r for r in pages.document_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert got["gap"].error.status == 413 and got["gap"].text is None and got["gap"].extraction_method is None
    assert got["edge"].text == "--- PAGE 20 ---\nseen"


def test_flat_pages_and_items_are_numbered(spark):
    rows = [("d", k, "x") for k in range(500)] + [(None, 9, "y")]
    frame = spark.createDataFrame(rows, "doc_key string, place int, text string").repartition(6)
    got = sorted((str(r.doc_key), r.page_no, r.place) for r in pages.number_page_rows(frame, "doc_key", [F.desc("place")]).collect())
    assert got == [("None", 1, 9)] + [("d", k + 1, 499 - k) for k in range(500)]
    items = spark.createDataFrame([("i", 2, ""), ("i", 1, "S"), ("i", 3, None), ("j", 5, "")], "doc_key string, place int, sr_no string")
    filled = india.number_items(items, "doc_key", ["place"]).collect()
    assert sorted((r.doc_key, r.place, r.sr_no) for r in filled) == [("i", 1, "S"), ("i", 2, "2"), ("i", 3, "3"), ("j", 5, "1")]


def test_compacting_pages_equals_compacting_documents(spark):
    frame = spark.range(0, 400).selectExpr(
        "cast(id % 40 as string) as doc_key", "cast(id div 40 as int) + 1 as page_no",
        "case when id % 3 = 0 then 'ocr' else 'digital' end as layer",
        "'  a' || repeat(' \\t', cast(id % 5 as int)) || '\\r\\n\\r b\\u00a0 ' || id || ' \\n\\n' as text",
    )
    by_page = {r.doc_key: r for r in prepare.prepare_pages(frame).collect()}
    by_document = {r.doc_key: r for r in prepare.prepare_texts(pages.document_text(frame)).collect()}
    assert len(by_page) == 40
    for key, row in by_page.items():
        other = by_document[key]
        assert (row.character_stored, row.error, row.character_count) == (
            other.character_stored, other.error, other.character_count)


def test_text_limits(spark):
    frame = spark.createDataFrame([(n, "x" * n) for n in (19, 20, 32768, 32769)], "n int, text string")
    got = {r.n: r for r in prepare.prepare_texts(frame).collect()}
    assert got[19].error.detail == "Extracted document text is insufficient"
    assert got[20].estimated_tokens == 5 and got[32768].estimated_tokens == 8192
    assert got[32769].error.status == 422 and got[32769].character_stored is None


def test_text_extractor_hook(spark):
    def factory():
        def extract(content, kind):
            if kind == "png":
                raise ValueError("engine failed")
            return [content.decode(), "second"]

        return extract

    frame = spark.createDataFrame(
        [("a", "pdf", bytearray(b"one")), ("b", "png", bytearray(b""))], "doc_key string, kind string, content binary")
    rows = sorted(tuple(r) for r in hooks.run_text_extractor(frame, factory).collect())
    assert rows == [("a", 1, "ocr", "one", None), ("a", 2, "ocr", "second", None), ("b", 1, "ocr", "", "engine failed")]


def test_pages_are_numbered_from_one(spark):
    frame = spark.createDataFrame([("d", ["x", "y"])], "doc_key string, pages array<string>")
    assert [tuple(r) for r in pages.number_pages(frame).select("page_no", "text").collect()] == [(1, "x"), (2, "y")]


def test_oversize_files_are_never_opened(spark, tmp_path):
    (tmp_path / "small.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "large.pdf").write_bytes(b"%PDF-1.7" + b"x" * (1 << 20))
    small, oversize = files.split_by_size(files.read_uploads(spark, str(tmp_path)), Limits(max_upload_mb=1))
    plans = [f._jdf.queryExecution().executedPlan().toString().replace(" ", "") for f in (small, oversize)]
    assert "LessThanOrEqual(length,1048576)]" in plans[0] and "GreaterThan(length,1048576)]" in plans[1]
    # Spark fails on reading any content over this length.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1 << 20)
    try:
        assert [bytes(r.content) for r in small.collect()] == [b"%PDF-1.7"]
        assert [r.length for r in oversize.collect()] == [(1 << 20) + 8]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
