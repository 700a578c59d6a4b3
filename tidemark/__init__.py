"""Lineage trust on Spark: what is out of date, and what has been attested absent."""
