"""Reusable DataFrame operators: range join, incremental loads, record entry."""
