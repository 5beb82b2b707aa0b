"""Choice of a country's schema and rules.

The country is a column of the rows. Each country has its own record type, so
a job is one branch per country over a filter that reaches the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.errors import INVALID_REQUEST, error
from ledgerloom.operators import india, usa
from ledgerloom.schemas import COUNTRIES

# Route prefixes of the three countries.
ROUTE_PREFIXES = {
    "usa": "/api/v1/usa/invoices",
    "india": "/api/v1/india/invoices",
    "uae": "/api/v1/invoices",
}

# Rules that change a record, for single documents and batch items alike.
RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "uae": usa.keep,
    "usa": usa.keep,
    "india": india.reconcile,
}


def country_of_route(path: Column) -> Column:
    """Country of a request path, null for any other path."""
    country = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, prefix in ROUTE_PREFIXES.items():
        country = country.when(path.startswith(f"{prefix}/"), F.lit(name))
    return country


def is_known_country(country: Column) -> Column:
    return F.coalesce(country.isin(*COUNTRIES), F.lit(False))


def unknown_country(country: Column) -> Column:
    """The error of a row that has no country, or one without a schema."""
    given = F.coalesce(country, F.lit("none"))
    return error(400, INVALID_REQUEST, F.concat(F.lit("Unknown country: "), given))


def split_by_country(rows: DataFrame, column: str = "country") -> dict[str, DataFrame]:
    return {name: rows.filter(F.col(column) == name) for name in COUNTRIES}


def apply_rules(invoices: DataFrame, country: str,
                hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The country's rules, or a caller's own rule in their place."""
    return invoices.transform(hook or RULES[country])
