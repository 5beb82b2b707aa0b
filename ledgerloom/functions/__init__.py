"""Column functions: text, money, dates, identifiers, errors and page layout."""
