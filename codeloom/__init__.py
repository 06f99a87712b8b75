"""Spark-native analytics over corpora of source-code repositories.

Every table carries a leading ``repo`` key; every operator is a function from
DataFrames to DataFrames. See README.md for the table layouts.
"""
