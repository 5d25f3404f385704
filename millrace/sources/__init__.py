"""Readers, file listings and writers."""
