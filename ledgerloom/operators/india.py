"""India invoice reconciliation.

The rules build on each other, so they run in three levels: identifiers and
sums, then the total, then the zero defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.identifiers import pan_from_gstin
from ledgerloom.functions.money import MONEY, sum_of, zero
from ledgerloom.functions.text import is_blank
from ledgerloom.operators.scans import numbered

_SUMS = {"taxable_amount": "_item_sum", "cgst_amount": "_cgst_sum", "sgst_amount": "_sgst_sum"}
_ZERO_DEFAULTS = ("igst_amount", "discount", "state_cess", "other_charges")


def fill_serial_numbers(items: Column) -> Column:
    """Position as serial number where an item has none."""
    return F.transform(
        items,
        lambda item, i: item.withField(
            "sr_no",
            F.when(is_blank(item["sr_no"]), (i + 1).cast("string")).otherwise(item["sr_no"]),
        ),
    )


def number_items(items: DataFrame, key: str, order: list) -> DataFrame:
    """``fill_serial_numbers`` for flat items: blanks get their position in the invoice.

    Positions come from range partitions, so an invoice of any length is numbered by many tasks.
    """
    placed = numbered(items, [key], order, "_position", "serials")
    filled = F.when(is_blank(F.col("sr_no")), F.col("_position").cast("string")).otherwise(F.col("sr_no"))
    return placed.withColumn("sr_no", filled).drop("_position")


def reconcile_headers(invoices: DataFrame) -> DataFrame:
    """Header rules over flat columns and the sums ``_item_sum, _cgst_sum, _sgst_sum``."""

    def from_sum(header: str, total: str) -> Column:
        return F.when(F.col(header).isNull() & (F.col(total) > 0), F.col(total)).otherwise(
            F.col(header)
        )

    date, due = F.col("invoice_date"), F.col("due_date")
    identified = invoices.withColumns(
        {
            "customer_pan": pan_from_gstin(F.col("customer_pan"), F.col("customer_gst")),
            "vendor_pan": pan_from_gstin(F.col("vendor_pan"), F.col("vendor_gst")),
            "invoice_date": F.when(is_blank(date) & ~is_blank(due), due).otherwise(date),
            **{header: from_sum(header, total) for header, total in _SUMS.items()},
        }
    )

    taxes = sum(
        (F.coalesce(F.col(c), zero()) for c in ("sgst_amount", "igst_amount")),
        F.coalesce(F.col("cgst_amount"), zero()),
    )
    total = (F.col("taxable_amount") + taxes).try_cast(MONEY)
    totalled = identified.withColumn(
        "invoice_amount",
        F.when(F.col("invoice_amount").isNull() & (taxes > 0), total).otherwise(
            F.col("invoice_amount")
        ),
    )

    irn = F.col("irn_number")
    return totalled.withColumns(
        {
            **{c: F.coalesce(F.col(c), zero()) for c in _ZERO_DEFAULTS},
            "irn_number": F.when(is_blank(irn), F.lit("0")).otherwise(irn),
        }
    ).drop(*_SUMS.values())


def reconcile_tables(headers: DataFrame, items: DataFrame, hsn_summary: DataFrame,
                     key: str = "doc_key") -> DataFrame:
    """The header rules for flat tables of headers, items and tax summary.

    Items are summed before they meet the headers, so a document with very
    many items costs one partial sum per task and no skewed join.
    """
    item_sums = items.groupBy(key).agg(F.sum("amount").try_cast(MONEY).alias("_item_sum"))
    tax_sums = hsn_summary.groupBy(key).agg(
        F.sum("cgst").try_cast(MONEY).alias("_cgst_sum"),
        F.sum("sgst").try_cast(MONEY).alias("_sgst_sum"),
    )
    joined = headers.join(item_sums, key, "left").join(tax_sums, key, "left")
    return reconcile_headers(joined)


def reconcile(invoices: DataFrame, invoice: str = "data", default_quantity: bool = False,
              rebuild_hsn: bool = False) -> DataFrame:
    """All rules on nested records. Sums run inside the row, without a shuffle.

    Two documented but inactive rules can be switched on: item quantity 1 when
    absent, and the header HSN/SAC code rebuilt from items and tax summary.
    """
    others = [c for c in invoices.columns if c != invoice]
    fields = invoices.schema[invoice].dataType.fieldNames()
    # Names of the record and of the row around it may overlap.
    carried = F.struct(*others).alias("_row") if others else F.lit(None).alias("_row")
    flat = invoices.select(
        carried, F.col(invoice).isNull().alias("_absent"), f"{invoice}.*"
    ).withColumns(
        {
            "items": fill_serial_numbers(F.col("items")),
            "_item_sum": sum_of(F.col("items"), "amount"),
            "_cgst_sum": sum_of(F.col("hsn_summary"), "cgst"),
            "_sgst_sum": sum_of(F.col("hsn_summary"), "sgst"),
        }
    )
    ruled = reconcile_headers(flat)
    if default_quantity:
        ruled = ruled.withColumn(
            "items",
            F.transform(
                "items",
                lambda i: i.withField(
                    "quantity", F.coalesce(i["quantity"], F.lit(1).cast(MONEY))
                ),
            ),
        )
    if rebuild_hsn:
        codes = F.concat(
            F.transform("items", lambda i: i["hsn_sac"]),
            F.transform("hsn_summary", lambda h: h["hsn"]),
        )
        rebuilt = F.array_join(
            F.array_distinct(F.filter(codes, lambda c: ~is_blank(c))), ", "
        )
        ruled = ruled.withColumn(
            "hsn_sac_code",
            F.when(is_blank(F.col("hsn_sac_code")), F.nullif(rebuilt, F.lit(""))).otherwise(
                F.col("hsn_sac_code")
            ),
        )
    record = F.when(~F.col("_absent"), F.struct(*fields)).alias(invoice)
    return ruled.select(*([f"_row.{c}" for c in others]), record).select(*invoices.columns)
