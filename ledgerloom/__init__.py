"""Bulk invoice data processing on Spark DataFrames.

Tables of uploads, page texts, OCR boxes and model replies go in; typed and
checked invoice tables for the UAE, the USA and India come out.
"""

from ledgerloom.limits import Limits
from ledgerloom.session import checkpoint_root, configure

__all__ = ["Limits", "checkpoint_root", "configure"]
