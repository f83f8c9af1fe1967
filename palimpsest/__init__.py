"""Versioned tables, commit histories and catalog metadata as Spark DataFrame jobs."""
