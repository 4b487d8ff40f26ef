"""Quillmark: a semantic note index and query engine expressed as Spark DataFrames."""
