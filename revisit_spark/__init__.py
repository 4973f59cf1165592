"""Repeat-visit detection over field-service job history, as Spark DataFrame jobs."""
