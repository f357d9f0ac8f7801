"""Sensitive-text, roster and corpus analytics written as Spark DataFrame jobs."""
