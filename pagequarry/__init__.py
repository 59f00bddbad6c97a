"""PySpark operators for analysing fetched web data."""
