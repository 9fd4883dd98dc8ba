"""A PySpark-native analytics engine for semi-structured financial filings."""
