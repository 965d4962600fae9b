"""Spark jobs for large collections of time-coded transcripts."""
