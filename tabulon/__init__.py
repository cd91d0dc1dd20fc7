"""Spreadsheet-semantics analytics on PySpark DataFrames."""
