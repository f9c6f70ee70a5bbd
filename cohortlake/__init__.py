"""Cohort time-series analytics expressed as Spark DataFrame jobs."""
