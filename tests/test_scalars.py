import random
import re
from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerloom.functions import dates, errors, identifiers, money, times


def column_of(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.o for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


MONEY_CASES = {
    None: None, "": None, "  ": None, "abc": None, "-": None, ".": None, "..": None, ".-": None,
    "12": 12, "12.5": 12.5, "1,234.50": 1234.5, "₹ 1,00,000": 100000, "5%": 5, "(100)": 100,
    "Rs. 500": 0.5, "1.234,56": 1.23456, "1e5": 15, "1.860.56": 1.86, "12-34": 12, "--5": -5,
    "٣": 3, "-5-": -5, "12.": 12, ".5": 0.5, "１２.5": 12.5,
    "7 of 9": 79, "$-3.2-4": -3.2, "4-.5": 4, "..8": 8, "-.-6": -6, "0.1.2.3": 0.1, "1-2-3": 1, "9-": 9, "-0": 0,
}


def test_money_cases(spark):
    got = column_of(spark, list(MONEY_CASES), money.clean_money)
    assert [None if g is None else float(g) for g in got] == [
        None if v is None else float(v) for v in MONEY_CASES.values()
    ]


def test_iso_dates(spark):
    rnd = random.Random(4)
    values = ["2026-01-15", "20260115", "2026-W03-1", "2026W031", "2026-W53", "2020-W53", "2026-1-5",
              "2026-01-15 ", "2025-02-29", "2024-02-29", "0000-01-01", "0001-W01-1", "9999-W52-5",
              "9999-W52-6", "9999-W52-7", "2026-W00-1", "2026-W1", "2026-W03-0", "2026-W03-8", "AED\n"]
    for _ in range(3000):
        y, m, d, w, k = rnd.randint(0, 9999), rnd.randint(0, 13), rnd.randint(0, 32), rnd.randint(0, 54), rnd.randint(0, 8)
        values += rnd.sample([f"{y:04}-{m:02}-{d:02}", f"{y:04}{m:02}{d:02}", f"{y:04}-W{w:02}-{k}",
                              f"{y:04}W{w:02}{k}", f"{y:04}-W{w:02}", f"{y:04}W{w:02}"], 2)

    def valid(value):
        try:
            return bool(date.fromisoformat(value))
        except ValueError:
            return False

    got = column_of(spark, values, dates.is_iso_date)
    assert [v for v, g in zip(values, got) if g != valid(v)] == []


def test_printed_dates(spark):
    got = column_of(spark, ["31-01-2026", "19. August 2026", "March 5, 2026", "soon"],
                    dates.normalise_printed_date)
    assert got == ["2026-01-31", "2026-08-19", "2026-03-05", None]
    # The shapes leave out no text that a spelling accepts.
    texts = ["2026-1-31", "1-1-2026", "march 5, 2026", "MAY 05, 2026", "5. may 2026", "5-Sep-2026", "5-sept-2026", "05 May 26", "+12026-01-01",
             "2026-02-30", " 2026-01-31", "2026-01-31 ", "31/01/2026x", "31.01.2026", "", "January 31,2026", "12 Dec. 2026", None]
    assert column_of(spark, texts, dates.normalise_printed_date) == column_of(
        spark, texts, lambda c: F.date_format(F.coalesce(*[F.try_to_date(c, f) for f in dates.PRINTED_DATE_FORMATS]), "yyyy-MM-dd"))


def test_identifiers(spark):
    assert column_of(spark, ["1" * 15, " " + "2" * 15 + "\xa0", "1" * 14, "1" * 15 + "\n1", "  "],
                     identifiers.is_trn) == [True, True, False, False, False]
    assert column_of(spark, ["AED", "aed", "AED\n", "AEDX"], identifiers.is_currency) == [True, False, False, False]
    assert column_of(spark, ["a.b-C_1", "", "x" * 100, "x" * 101, "a b", "a\n", None],
                     identifiers.has_safe_shape) == [True, False, True, False, False, False, False]
    assert column_of(spark, ["batches/loc_1", " loc_1 ", "batches/batches/x"], identifiers.job_key) == [
        "loc_1", "loc_1", "batches/x"]
    assert column_of(spark, [" a ", "", "   ", "x" * 100, "x" * 101, " " * 100 + "x"],
                     identifiers.is_valid_invoice_id) == [True, False, False, True, False, False]


def test_pan_needs_length_only(spark):
    gst = ["33qwert4321y1zx", " 33QWERT4321Y1ZX ", "GSTIN : 33QWERT4321Y1ZX", None, ""]
    assert column_of(spark, gst, lambda g: identifiers.pan_from_gstin(F.lit(""), g)) == [
        "QWERT4321Y", "QWERT4321Y", "", "", ""]
    assert column_of(spark, gst[:1], lambda g: identifiers.pan_from_gstin(F.lit("KEPT"), g)) == ["KEPT"]


def test_job_name_is_reproducible(spark):
    at = F.lit(datetime(2026, 1, 2, 3, 4, 5))
    names = {column_of(spark, ["payload"], lambda p: identifiers.job_name(at, p))[0] for _ in range(2)}
    assert len(names) == 1
    assert re.fullmatch(r"batches/loc_20260102_030405_[0-9a-f]{8}", names.pop())


def test_times(spark):
    start = F.lit("2026-01-01 00:00:00").cast("timestamp")
    later = lambda micros: F.timestamp_micros(F.unix_micros(start) + micros)
    rows = spark.range(1).select(
        times.duration_ms(start, later(2500)).alias("a"),
        times.duration_ms(start, later(3500)).alias("b"),
        times.elapsed_seconds(start, later(1234567)).alias("c"),
        times.elapsed_seconds(later(5), start).alias("d"),
        times.iso_timestamp(start).alias("e"),
        times.iso_timestamp(later(12)).alias("f"),
    ).first()
    assert tuple(rows) == (2, 4, 1.235, 0.0, "2026-01-01T00:00:00+00:00", "2026-01-01T00:00:00.000012+00:00")


def test_error_source_and_retry(spark):
    cases = [("file_too_large", 413, "client", False), ("ocr_unavailable", 503, "ocr", True),
             ("document_extraction_failed", 422, "ocr", False), ("ollama_service_error", 504, "ollama", True),
             ("configuration_error", 503, "server", True), ("x", 429, "client", True), ("x", 500, "server", False)]
    rows = spark.createDataFrame([c[:2] for c in cases], "code string, status int").select(
        errors.error_source(F.col("code"), F.col("status")), errors.is_retryable(F.col("status"))).collect()
    assert [tuple(r) for r in rows] == [c[2:] for c in cases]
