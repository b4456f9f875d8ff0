"""Keyspace analytics on PySpark DataFrames."""
