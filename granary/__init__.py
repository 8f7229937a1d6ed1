"""Columnar tables, arrays and expressions on Spark DataFrames."""
