"""Audits of large corpora of source files and text documents, as Spark DataFrames."""
