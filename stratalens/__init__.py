"""Prepared-index corpus intelligence on PySpark DataFrames."""
