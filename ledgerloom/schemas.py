"""Invoice records per country and the tables around them.

A country's record is declared, never inferred: text fields, money fields and
nested lists of records.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ledgerloom.functions.money import MONEY_SQL


@dataclass(frozen=True)
class RecordSchema:
    """Field names by type. ``order`` is the order in the output struct."""

    order: tuple[str, ...]
    money: frozenset[str]
    lists: dict[str, RecordSchema] = field(default_factory=dict)
    # Text fields with a value other than null when the key is absent.
    defaults: dict[str, str] = field(default_factory=dict)
    # Text fields that also accept whole numbers.
    text_or_int: frozenset[str] = frozenset()

    def sql(self) -> str:
        parts = []
        for name in self.order:
            if name in self.lists:
                parts.append(f"{name}:array<{self.lists[name].sql()}>")
            else:
                parts.append(f"{name}:{MONEY_SQL if name in self.money else 'string'}")
        return f"struct<{','.join(parts)}>"


def _record(order: str, money: str, **options) -> RecordSchema:
    return RecordSchema(tuple(order.split()), frozenset(money.split()), **options)


# Field names of the three countries' invoice records.
UAE = _record(
    "vendor_name vendor_address vendor_trn_no invoice_no invoice_date po_no buyer_name"
    " buyer_address buyer_trn_no vat_rate net_amount total_tax grand_total items bank_name"
    " account_number iban swift_bic bank_branch currency",
    "vat_rate net_amount total_tax grand_total",
    lists={
        "items": _record(
            "item qty unit_price vat_rate net_amount line_total",
            "qty unit_price vat_rate net_amount line_total",
        )
    },
    defaults={"currency": "AED"},
)

USA = _record(
    "invoice_no invoice_date po_no net_amount sales_tax_rate total_sales_tax"
    " shipping_handling_freight grand_total payable_amount items vendor_name vendor_ein"
    " state_tax_permit_license vendor_address customer_name customer_tax_id_ein"
    " resale_exemption_certificate_no customer_billing_address bank_name routing_number"
    " account_number swift_bic bank_address_location remark",
    "net_amount sales_tax_rate total_sales_tax shipping_handling_freight grand_total"
    " payable_amount",
    lists={
        "items": _record(
            "line_number item_description qty unit unit_price tax_rate line_total",
            "qty unit_price tax_rate line_total",
        )
    },
)

INDIA = _record(
    "customer_name customer_address customer_gst vendor_name vendor_address vendor_gst"
    " vendor_pan invoice_number invoice_date taxable_amount igst_amount cgst_amount sgst_amount"
    " invoice_amount hsn_sac_code discount state_cess other_charges irn_number customer_pan"
    " bank_name bank_branch bank_account_number ifsc_code due_date items hsn_summary",
    "taxable_amount igst_amount cgst_amount sgst_amount invoice_amount discount state_cess"
    " other_charges",
    lists={
        "items": _record(
            "sr_no description quantity unit rate amount hsn_sac", "quantity rate amount"
        ),
        "hsn_summary": _record(
            "hsn tax_rate taxable_amount cgst sgst igst", "tax_rate taxable_amount cgst sgst igst"
        ),
    },
    defaults={"irn_number": "0"},
    text_or_int=frozenset({"irn_number"}),
)

COUNTRIES: dict[str, RecordSchema] = {"uae": UAE, "usa": USA, "india": INDIA}

TOKEN_USAGE_SQL = (
    "struct<input_tokens:bigint,output_tokens:bigint,thoughts_tokens:bigint,"
    "total_tokens:bigint,execution_time_ms:bigint,model:string>"
)

# Tables read or written by the jobs.
DOC_PAGES_SQL = "doc_key string, page_no int, layer string, text string"
MODEL_RESPONSES_SQL = "doc_key string, http_status int, body string, failure string"
BATCH_PAYLOAD_SQL = (
    "batch_job_name string, country string, created_at timestamp, "
    "items array<struct<id:string,custom_id:string,text:string,character_stored:string>>"
)
REQUEST_EVENTS_SQL = (
    "token string, request_id string, operation string, kind string, ts timestamp"
)
ERRORS_SQL = (
    "occurred_at timestamp, seq bigint, request_id string, source string, code string, "
    "http_status int, retryable boolean, detail string"
)
