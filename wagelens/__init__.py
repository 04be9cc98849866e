"""wagelens: a PySpark-native analytics engine for public wage filings."""
