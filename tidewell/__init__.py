"""Spark-native engine for conversational data: ingest, enrich, search, evaluate.

Every public operator is a function of DataFrames and returns a DataFrame.
"""
