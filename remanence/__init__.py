"""Remanence: a Spark-native engine for long-term text memory.

Records, weighted relations, vectors and an activity log are DataFrames; every
operator is a function from DataFrames to a DataFrame, so Catalyst sees one
declarative plan from the scan to the result.
"""
