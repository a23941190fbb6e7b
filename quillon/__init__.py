"""Quillon: a relational algebra with true set semantics, built on Spark DataFrames."""
