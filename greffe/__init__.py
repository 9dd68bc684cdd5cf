"""Triage of legislative amendment batches as Spark DataFrame jobs."""
