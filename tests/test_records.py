import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import india, items, label_fields, parse, uae
from ledgerloom.operators.countries import apply_rules, country_of_route
from ledgerloom.schemas import COUNTRIES


def read(spark, country, documents):
    frame = spark.createDataFrame(list(enumerate(documents)), "i int, json string")
    return parse.read_records(frame, "json", COUNTRIES[country]).orderBy("i").collect()


STRICT = [
    ("{}", []), ('{"vendor_name": 5}', ["vendor_name"]), ('{"vendor_name": null}', []),
    ('{"po_no": ["a"], "iban": true}', ["po_no", "iban"]), ('{"items": null}', ["items"]),
    ('{"items": "x"}', ["items"]), ('{"items": [{}, 3, {"item": 1, "qty": []}]}', ["items.1", "items.2.item"]),
    ("[1]", ["$"]), ('"text"', ["$"]), ('{"a":', ["$"]), ('{"net_amount": NaN}', ["$"]),
    ('{"net_amount": 1e400}', ["net_amount"]), ('{"vendor_name": "a"} {"vendor_name": "b"}', ["$"]),
    ('{"vendor_name": "a"}, {}', ["$"]), ('{"vendor_name":"a"}, "note": {"k":1}', ["$"]),
    ('{"vendor_name":"a"},"record":{"vendor_name":"evil"}', ["$"]), ('{"vendor_name":"a"}, 1],{}', ["$"]),
    ('{"net_amount": 10000000000000000, "total_tax": "AED 99999999999999999"}', ["net_amount", "total_tax"]),
    ('{"net_amount": 9999999999999999, "total_tax": "-"}', []), ("{'vendor_name': 'a'}", ["$"]), (None, ["$"]),
    ('{"other": {"vendor_name": 5}, "items": [{"extra": []}]}', []),
]


def test_strict_types(spark):
    rows = read(spark, "uae", [d for d, _ in STRICT])
    assert [sorted(r.problems) for r in rows] == [sorted(p) for _, p in STRICT]
    assert all((r.data is None) == bool(r.problems) for r in rows)


def test_values_and_defaults(spark):
    absent, null, filled = (r.data for r in read(spark, "uae", [
        "{}", '{"currency": null}',
        json.dumps({"currency": "USD", "net_amount": 1e5, "total_tax": "1e5", "grand_total": True, "vat_rate": [5],
                    "items": [{"item": "a", "qty": "2 pcs"}, {"line_total": 7.25}]})]))
    assert absent.currency == "AED" and absent["items"] == [] and null.currency is None
    assert (filled.net_amount, filled.total_tax, filled.grand_total, filled.vat_rate) == (100000, 15, None, None)
    assert filled["items"][0].qty == 2 and float(filled["items"][1].line_total) == 7.25
    last = read(spark, "uae", ['{"vendor_name": "a", "vendor_name": "b"}'])[0].data
    assert last.vendor_name == "b"


def test_irn_union(spark):
    documents = ["{}", '{"irn_number": null}', '{"irn_number": 12}', '{"irn_number": "x"}', '{"irn_number": 5.0}',
                 '{"irn_number": true}', '{"irn_number": 5.5}', '{"irn_number": []}']
    rows = read(spark, "india", documents)
    assert [r.data.irn_number if r.data else r.problems for r in rows] == [
        "0", None, "12", "x", "5", "1", ["irn_number"], ["irn_number"]]


def test_json_cleaning(spark):
    fence = "```"
    cases = {
        ' {"a":1} ': '{"a":1}', f'{fence}json\n{{"a":1}}\n{fence}': '{"a":1}',
        f'x {fence}{{"a":{{}}}}{fence} {fence}{{"b":1}}{fence}': '{"a":{}}', 'say {"a":{"b":2}} now': '{"a":{"b":2}}',
        "} {": "} {", "none": "none", "": "",
    }
    frame = spark.createDataFrame([(c,) for c in cases], "s string")
    assert {r.s: r.j for r in frame.select("s", parse.clean_json(F.col("s")).alias("j")).collect()} == cases


def test_reply_errors_are_data(spark):
    good = json.dumps({"message": {"content": '{"invoice_no": "1"}'}, "eval_count": 3, "prompt_eval_count": None,
                       "total_duration": 2_999_999})
    rows = [("ok", 200, good, None), ("http", 500, "y" * 300, None), ("html", 200, "<html>", None),
            ("list", 200, "[1]", None), ("gone", None, None, "connect"), ("slow", None, None, "timeout"),
            ("odd", None, None, "boom"), ("empty", 200, "{}", None), ("missing", None, None, None)]
    frame = spark.createDataFrame(rows, "doc_key string, http_status int, body string, failure string")
    got = {r.doc_key: r for r in parse.parse_replies(frame, "usa").collect()}
    assert {k: (r.error.status if r.error else None) for k, r in got.items()} == {
        "ok": None, "http": 502, "html": 500, "list": 500, "gone": 503, "slow": 504, "odd": 502, "empty": 422, "missing": 502}
    usage = got["ok"].token_usage
    assert (usage.input_tokens, usage.output_tokens, usage.total_tokens, usage.execution_time_ms) == (0, 3, 3, 2)
    assert got["http"].error.detail == "Ollama returned HTTP 500: " + "y" * 200
    assert got["ok"].data.invoice_no == "1"


BASE = {"vendor_name": "Gulf", "invoice_no": "INV-1", "invoice_date": "2026-01-20", "net_amount": 2000, "total_tax": 100,
        "grand_total": 2100, "vendor_trn_no": "1" * 15, "buyer_trn_no": "2" * 15}
TEXT = "Gulf inv - 1 trn " + "1" * 15 + " buyer " + "2" * 15
WARNINGS = [
    ({}, TEXT, []),
    ({"vendor_name": ""}, TEXT, ["vendor_name is missing"]),
    ({"invoice_no": None}, TEXT, ["invoice_no is missing"]),
    ({"invoice_date": None}, TEXT, ["invoice_date is missing"]),
    ({"net_amount": 0}, TEXT, ["net_amount is missing"]),
    ({"grand_total": None}, TEXT, ["grand_total is missing"]),
    ({"vendor_trn_no": ""}, TEXT, ["vendor_trn_no is missing"]),
    ({"vendor_trn_no": " "}, TEXT, ["vendor_trn_no must contain exactly 15 digits"]),
    ({"buyer_trn_no": "12"}, TEXT + " 12 ", ["buyer_trn_no must contain exactly 15 digits"]),
    ({"buyer_trn_no": None}, TEXT, []),
    ({"invoice_date": "2026-1-5"}, TEXT, ["invoice_date is not a valid YYYY-MM-DD date"]),
    ({"currency": "aed"}, TEXT, ["currency must be a three-letter uppercase code"]),
    ({"currency": "AED\n"}, TEXT, ["currency must be a three-letter uppercase code"]),
    ({"grand_total": 2100.02}, TEXT, []),
    ({"grand_total": 2100.03}, TEXT, ["subtotal, VAT, and grand_total do not balance"]),
    ({"total_tax": None, "grand_total": 2000}, TEXT, []),
    ({"invoice_no": "Straße 1"}, TEXT + " STRASSE 1", []),
    ({"invoice_no": "Z"}, "x", ["invoice_no was not found in extracted_text", "vendor_trn_no was not found in extracted_text",
                                "buyer_trn_no was not found in extracted_text"]),
    ({"invoice_no": "Z"}, "", []),
]


def test_uae_warnings(spark):
    rows = [(i, json.dumps({**BASE, **change}), text) for i, (change, text, _) in enumerate(WARNINGS)]
    frame = spark.createDataFrame(rows, "i int, json string, character_stored string")
    checked = uae.validate(parse.read_records(frame, "json", COUNTRIES["uae"])).orderBy("i").collect()
    assert [r.validation.warnings for r in checked] == [w for _, _, w in WARNINGS]
    assert [r.validation.is_valid for r in checked] == [not w for _, _, w in WARNINGS]


def ruled(spark, document, **options):
    frame = spark.createDataFrame([(json.dumps(document),)], "json string")
    return india.reconcile(parse.read_records(frame, "json", COUNTRIES["india"]), **options).first().data


def test_india_totals(spark):
    data = ruled(spark, {"items": [{"amount": 21212}], "hsn_summary": [{"cgst": 1909.07, "sgst": 1909.07, "igst": 5}],
                         "vendor_gst": "33QWERT4321Y1ZX", "due_date": "2026-01-31"})
    assert float(data.invoice_amount) == 25030.14 and float(data.taxable_amount) == 21212
    assert (data.igst_amount, data.discount, data.state_cess, data.other_charges) == (0, 0, 0, 0)
    assert (data.vendor_pan, data.invoice_date, data.irn_number) == ("QWERT4321Y", "2026-01-31", "0")
    assert data["items"][0].sr_no == "1" and data["items"][0].quantity is None


def test_india_guards(spark):
    data = ruled(spark, {"items": [{"amount": 0}, {"sr_no": "A"}, {"sr_no": ""}], "hsn_summary": [{"cgst": -1}],
                         "vendor_gst": "GSTIN : 33QWERT4321Y1ZX", "customer_pan": "KEPT", "customer_gst": "2" * 15,
                         "irn_number": "", "taxable_amount": None})
    assert (data.taxable_amount, data.cgst_amount, data.invoice_amount) == (None, None, None)
    assert (data.vendor_pan, data.customer_pan, data.irn_number) == (None, "KEPT", "0")
    assert [i.sr_no for i in data["items"]] == ["1", "A", "3"]
    given = ruled(spark, {"taxable_amount": 100, "igst_amount": 18, "invoice_amount": None, "cgst_amount": 0})
    assert float(given.invoice_amount) == 118 and float(given.cgst_amount) == 0


def test_india_optional_rules(spark):
    document = {"items": [{"hsn_sac": "1"}, {"hsn_sac": "2", "quantity": 3}], "hsn_summary": [{"hsn": "2"}, {"hsn": ""}]}
    assert ruled(spark, document).hsn_sac_code is None
    data = ruled(spark, document, default_quantity=True, rebuild_hsn=True)
    assert data.hsn_sac_code == "1, 2" and [int(i.quantity) for i in data["items"]] == [1, 3]


def test_rejected_records_stay_null(spark):
    frame = spark.createDataFrame([("[]",)], "json string")
    row = apply_rules(parse.read_records(frame, "json", COUNTRIES["india"]), "india").first()
    assert row.data is None and row.problems == ["$"]


def test_flat_rules_equal_nested_rules(spark):
    documents = [json.dumps({"items": [{"amount": a} for a in range(n)], "hsn_summary": [{"cgst": n, "sgst": None}]})
                 for n in range(6)]
    frame = spark.createDataFrame([(str(i), d) for i, d in enumerate(documents)], "doc_key string, json string")
    records = parse.read_records(frame, "json", COUNTRIES["india"]).drop("problems", "json")
    nested = india.reconcile(records).select("doc_key", "data.taxable_amount", "data.invoice_amount")
    headers = records.select("doc_key", "data.*").drop("items", "hsn_summary")
    flat = india.reconcile_tables(
        headers,
        items.flatten(records.select("doc_key", "data.items"), "doc_key", "items", keep_empty=False),
        items.flatten(records.select("doc_key", "data.hsn_summary"), "doc_key", "hsn_summary", keep_empty=False),
    ).select("doc_key", "taxable_amount", "invoice_amount")
    assert sorted(nested.collect()) == sorted(flat.collect())


def test_long_lists_stay_flat(spark):
    flat = spark.range(0, 1000).selectExpr(
        "case when id < 3 then 'short' else 'long' end as key",
        "cast(case when id < 3 then id else id - 3 end as int) + 1 as position", "id as v")
    nested = {r.key: r for r in items.nest(flat, "key", "rows", max_items=10).collect()}
    assert [x.v for x in nested["short"].rows] == [0, 1, 2] and nested["short"].error is None
    assert nested["long"].rows is None and nested["long"].n_items == 997
    assert nested["long"].error.detail == "List has more than 10 elements: 997"


@pytest.mark.parametrize("path, country", [
    ("/api/v1/invoices/extract", "uae"), ("/api/v1/usa/invoices/complete", "usa"),
    ("/api/v1/india/invoices/batch/submit", "india"), ("/api/v1/invoicesX", None), ("/health", None)])
def test_routes(spark, path, country):
    assert spark.createDataFrame([(path,)], "p string").select(country_of_route(F.col("p"))).first()[0] == country


def test_labels_of_synthetic_invoices(spark):
    texts = {
        "india": "due date: 2-Nov-2025\n  BILLED TO : Teak & Sons \nTotal: Rs 731.50\nrecipient gstin: 33QWERT4321Y1ZX PAN:QWERT4321Y\n"
                 "Rice bags, SAC/HSN none | SAC: 1006 |\nUTGST (3 %): 21.3\nbill no.: 7/2025\nSeller: Mango Mills\n"
                 "Taxable: 710.20",
        "uae": "IBAN: AE99 0000\nBill No: B-77 | copy\nSubtotal: 40\nDate: 4. May 2025\nvendor: Dune Tools\nVAT rate: 2.5 %\n"
               "vendor trn: 123\nCustomer TRN: 555566667777888\nTotal VAT: AED 1.00\nTotal: 41.00 dirham\n",
    }
    got = {c: label_fields.extract_fields(spark.createDataFrame([(t,)], "text string"), c).first() for c, t in texts.items()}
    i, u = got["india"], got["uae"]
    assert (i.vendor_name, i.customer_name, i.customer_gst, i.customer_pan) == ("Mango Mills", "Teak & Sons", "33QWERT4321Y1ZX", "QWERT4321Y")
    assert (i.due_date, i.invoice_number, i.hsn_sac_code, i.vendor_pan) == ("2025-11-02", "7/2025", "1006", None)
    assert (float(i.taxable_amount), float(i.sgst_amount), i.cgst_amount) == (710.2, 21.3, None)
    assert (u.vendor_name, u.vendor_trn_no, u.buyer_trn_no) == ("Dune Tools", None, "555566667777888")
    assert (u.invoice_no, u.invoice_date, u.iban) == ("B-77", "2025-05-04", "AE99 0000")
    assert (float(u.net_amount), float(u.vat_rate), float(u.total_tax), float(u.grand_total)) == (40, 2.5, 1, 41)
