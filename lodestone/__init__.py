"""Lodestone: code intelligence and retrieval analytics on PySpark DataFrames."""
