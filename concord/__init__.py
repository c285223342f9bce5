"""Constraint, collection and corpus operators for Spark DataFrames."""
