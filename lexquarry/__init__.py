"""Lexquarry: citation analytics over document collections, as Spark DataFrames."""
