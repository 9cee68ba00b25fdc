"""Credential-leak analytics on Spark: scan, detect, deduplicate, score and report."""
