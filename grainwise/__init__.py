"""Trusted tabular analytics expressed as Spark DataFrame jobs."""
