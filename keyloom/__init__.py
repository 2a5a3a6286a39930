"""Keyed-dataset analytics on PySpark DataFrames.

Every operator is a plain function from DataFrames to a DataFrame.
"""
