"""Spark-native preparation and analysis of fine-tuning corpora."""

from millrace.session import build_session, read_table

__all__ = ["build_session", "read_table"]
