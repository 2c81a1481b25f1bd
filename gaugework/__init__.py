"""Spark jobs that turn company reports into comparable figures."""
