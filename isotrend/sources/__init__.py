"""Readers for untidy tables, and writers."""
