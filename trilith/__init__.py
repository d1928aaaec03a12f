"""Trilith: read-only SQL, Cypher and XQuery over Spark DataFrames."""
