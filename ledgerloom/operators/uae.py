"""UAE invoice checks. Values never change; every finding is a warning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import is_iso_date
from ledgerloom.functions.identifiers import is_currency, is_trn
from ledgerloom.functions.text import fold, is_blank

# Largest difference between net + tax and total that still balances.
TOLERANCE = "0.02"


def _is_missing(value: Column) -> Column:
    """Null or zero: an amount of zero counts as not given."""
    return F.coalesce(value == 0, F.lit(True))


def _warning(condition: Column, text: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(text))


def _missing_warnings(invoice: Column) -> list[Column]:
    texts = ("vendor_name", "invoice_no", "invoice_date")
    amounts = ("net_amount", "grand_total")
    return [_warning(is_blank(invoice[n]), f"{n} is missing") for n in texts] + [
        _warning(_is_missing(invoice[n]), f"{n} is missing") for n in amounts
    ]


def _trn_warnings(invoice: Column) -> list[Column]:
    found = []
    for name, required in (("vendor_trn_no", True), ("buyer_trn_no", False)):
        value = invoice[name]
        if required:
            found.append(_warning(is_blank(value), f"{name} is missing"))
        found.append(
            _warning(
                ~is_blank(value) & ~is_trn(value), f"{name} must contain exactly 15 digits"
            )
        )
    return found


def _date_warnings(invoice: Column, names: tuple[str, ...]) -> list[Column]:
    return [
        _warning(
            ~is_blank(invoice[n]) & ~is_iso_date(invoice[n]),
            f"{n} is not a valid YYYY-MM-DD date",
        )
        for n in names
    ]


def _balance_warning(invoice: Column) -> Column:
    net, total = invoice["net_amount"], invoice["grand_total"]
    tax = F.coalesce(invoice["total_tax"], F.lit(0).cast("decimal(24,8)"))
    difference = F.abs(net + tax - total)
    return _warning(
        ~_is_missing(net)
        & ~_is_missing(total)
        & (difference > F.lit(TOLERANCE).cast("decimal(3,2)")),
        "subtotal, VAT, and grand_total do not balance",
    )


def _evidence_warnings(invoice: Column, text: Column, folded_text: Column) -> list[Column]:
    """Identifiers that do not occur in the text they were read from."""
    return [
        _warning(
            ~is_blank(text)
            & ~is_blank(invoice[n])
            & ~folded_text.contains(fold(invoice[n])),
            f"{n} was not found in extracted_text",
        )
        for n in ("invoice_no", "vendor_trn_no", "buyer_trn_no")
    ]


def validate(invoices: DataFrame, invoice: str = "data", text: str = "character_stored",
             date_fields: tuple[str, ...] = ("invoice_date",)) -> DataFrame:
    """Adds ``validation``: ``struct<is_valid, warnings>`` in a fixed order."""
    record = F.col(invoice)
    folded = invoices.withColumn("_folded", fold(F.col(text)))
    warnings = F.array_compact(
        F.array(
            *_missing_warnings(record),
            *_trn_warnings(record),
            *_date_warnings(record, date_fields),
            _warning(
                ~is_blank(record["currency"]) & ~is_currency(record["currency"]),
                "currency must be a three-letter uppercase code",
            ),
            _balance_warning(record),
            *_evidence_warnings(record, F.col(text), F.col("_folded")),
        )
    )
    checked = folded.withColumn("_warnings", warnings)
    result = F.struct(
        (F.size("_warnings") == 0).alias("is_valid"), F.col("_warnings").alias("warnings")
    )
    return checked.withColumn(
        "validation", F.when(record.isNotNull(), result)
    ).drop("_folded", "_warnings")
