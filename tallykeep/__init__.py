"""Certified incremental maintenance of grouped aggregates on Spark."""
