"""Spark-first file-metadata analytics and scrubbing engine."""
