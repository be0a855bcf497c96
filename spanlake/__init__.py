"""Corpus-scale detection, redaction and audit of personal data on Spark DataFrames."""
