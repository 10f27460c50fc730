"""Earthquake-exposure analytics on PySpark DataFrames."""
