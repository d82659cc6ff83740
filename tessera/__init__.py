"""Sensitive-data analytics on Spark: find, score, redact and evaluate personal data in text columns."""
