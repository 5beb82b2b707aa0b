"""Invoice fields read from printed labels.

A deterministic stand-in for the model call: each field has an ordered list of
patterns, the first pattern that matches wins, and within a pattern the first
matching line. Patterns are columns over the whole text, so the job is a
projection without shuffle or join. Its answers are not the model's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import normalise_printed_date
from ledgerloom.functions.money import clean_money
from ledgerloom.functions.text import non_empty, strip


@dataclass(frozen=True)
class FieldRule:
    """``kind`` is ``text``, ``date`` or ``money``."""

    name: str
    patterns: tuple[str, ...]
    kind: str = "text"


def _labels(labels: str, value: str = r"[^\n|]*[^\n| ]") -> str:
    """Pattern of a line that starts with a label, a colon and the value."""
    return rf"(?im)^[ \t]*(?:{labels})[ \t]*:[ \t]*({value})"


_AMOUNT = r"[^\n|]*?[0-9][0-9.,]*"
_RATE = r"[^\n|]*?[0-9][0-9.]*[ ]?%?"
_PERCENT_NOTE = r"(?:[ \t]*\([^)\n]*\))?"

# Printed labels and identifier shapes of each country.
RULES: dict[str, tuple[FieldRule, ...]] = {
    "uae": (
        FieldRule("vendor_name", (_labels("supplier name|vendor name|supplier|vendor"),)),
        FieldRule("vendor_address", (_labels("supplier address|vendor address"),)),
        FieldRule("vendor_trn_no", (_labels("supplier trn|vendor trn", r"[0-9]{15}"),)),
        FieldRule(
            "invoice_no",
            (_labels("tax invoice no\\.?|invoice number|invoice no\\.?|bill no\\.?|receipt no\\.?"),),
        ),
        FieldRule("invoice_date", (_labels("invoice date|date"),), "date"),
        FieldRule("po_no", (_labels("po number|po no\\.?|purchase order"),)),
        FieldRule("buyer_name", (_labels("buyer name|customer name|buyer|customer"),)),
        FieldRule("buyer_address", (_labels("buyer address|customer address"),)),
        FieldRule("buyer_trn_no", (_labels("buyer trn|customer trn", r"[0-9]{15}"),)),
        FieldRule("vat_rate", (_labels("vat rate", _RATE),), "money"),
        FieldRule("net_amount", (_labels("total net amount|net amount|subtotal", _AMOUNT),), "money"),
        FieldRule("total_tax", (_labels("total vat amount|vat amount|total vat", _AMOUNT),), "money"),
        FieldRule(
            "grand_total",
            (_labels("invoice grand total|grand total", _AMOUNT), _labels("total", _AMOUNT)),
            "money",
        ),
        FieldRule("iban", (_labels("iban"),)),
        FieldRule("swift_bic", (_labels("swift/bic|swift|bic"),)),
        FieldRule("currency", (_labels("currency", r"[A-Z]{3}"),)),
    ),
    "usa": (
        FieldRule("invoice_no", (_labels("invoice number|invoice no\\.?|bill no\\.?"),)),
        FieldRule("invoice_date", (_labels("invoice date|date"),), "date"),
        FieldRule("po_no", (_labels("po number|po no\\.?|purchase order"),)),
        FieldRule("net_amount", (_labels("net amount|subtotal", _AMOUNT),), "money"),
        FieldRule("sales_tax_rate", (_labels("sales tax rate", _RATE),), "money"),
        FieldRule("total_sales_tax", (_labels("total sales tax|sales tax", _AMOUNT),), "money"),
        FieldRule(
            "shipping_handling_freight",
            (_labels("shipping & freight|shipping & handling|shipping|freight", _AMOUNT),),
            "money",
        ),
        FieldRule("grand_total", (_labels("grand total|invoice total", _AMOUNT),), "money"),
        FieldRule(
            "payable_amount",
            (_labels("total balance payable|balance payable|amount due|total due", _AMOUNT),),
            "money",
        ),
        FieldRule("vendor_name", (_labels("vendor|seller|remit from"),)),
        FieldRule("vendor_ein", (_labels("vendor ein|federal ein|ein", r"[0-9]{2}-[0-9]{7}"),)),
        FieldRule("vendor_address", (_labels("vendor address|address"),)),
        FieldRule("customer_name", (_labels("customer|client|bill to"),)),
        FieldRule(
            "customer_tax_id_ein",
            (_labels("customer tax id|customer ein", r"[0-9]{2}-[0-9]{7}"),),
        ),
        FieldRule("routing_number", (_labels("routing number|aba", r"[0-9]{9}"),)),
        FieldRule("account_number", (_labels("account number|account no\\.?"),)),
    ),
    "india": (
        FieldRule("vendor_name", (_labels("supplier|vendor|seller"),)),
        FieldRule("vendor_address", (_labels("supplier address|vendor address"),)),
        FieldRule("vendor_gst", (_labels("supplier gstin|vendor gstin|gstin", r"[0-9A-Z]{15}"),)),
        FieldRule(
            "vendor_pan", (r"(?im)^[ \t]*(?:supplier|vendor)[^\n]*\bPAN[ \t]*:[ \t]*([0-9A-Z]{10})",)
        ),
        FieldRule("customer_name", (_labels("customer|billed to|name"),)),
        FieldRule("customer_address", (_labels("customer address|billing address"),)),
        FieldRule("customer_gst", (_labels("customer gstin|recipient gstin", r"[0-9A-Z]{15}"),)),
        FieldRule(
            "customer_pan", (r"(?im)^[ \t]*(?:customer|recipient)[^\n]*\bPAN[ \t]*:[ \t]*([0-9A-Z]{10})",)
        ),
        FieldRule("invoice_number", (_labels("invoice number|invoice no\\.?|bill no\\.?"),)),
        FieldRule("invoice_date", (_labels("invoice date|date"),), "date"),
        FieldRule("due_date", (_labels("due date"),), "date"),
        FieldRule("taxable_amount", (_labels("taxable amount|taxable", _AMOUNT),), "money"),
        FieldRule("cgst_amount", (_labels("cgst" + _PERCENT_NOTE, _AMOUNT),), "money"),
        FieldRule("sgst_amount", (_labels("(?:sgst/utgst|sgst|utgst)" + _PERCENT_NOTE, _AMOUNT),), "money"),
        FieldRule("igst_amount", (_labels("igst" + _PERCENT_NOTE, _AMOUNT),), "money"),
        FieldRule(
            "invoice_amount",
            (_labels("invoice grand total|grand total", _AMOUNT), _labels("total", _AMOUNT)),
            "money",
        ),
        FieldRule("hsn_sac_code", (r"(?i)\b(?:HSN|SAC)(?:/SAC)?[ \t]*:[ \t]*([0-9]{4,8})",)),
        FieldRule("irn_number", (_labels("irn", r"[0-9a-fA-F]{64}"),)),
        FieldRule("ifsc_code", (_labels("ifsc code|ifsc", r"[A-Z]{4}0[0-9A-Z]{6}"),)),
    ),
}


def _first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[non_empty(F.regexp_extract(text, p, 1)) for p in patterns])


def _value(found: Column, kind: str) -> Column:
    if kind == "money":
        return clean_money(found)
    if kind == "date":
        return F.coalesce(normalise_printed_date(found), found)
    return found


def extract_fields(texts: DataFrame, country: str, text: str = "text") -> DataFrame:
    """Adds one column per field of the country's rules.

    Matching and conversion are separate projections, so each pattern runs
    once however often its result is used.
    """
    rules = RULES[country]
    matched = texts.withColumns(
        {r.name: strip(_first_match(F.col(text), r.patterns)) for r in rules}
    )
    return matched.withColumns(
        {r.name: _value(F.col(r.name), r.kind) for r in rules if r.kind != "text"}
    )
