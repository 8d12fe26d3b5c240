"""Spark-first analytics for append-only research records around company announcements."""
