"""Derived views and the reports built on them."""
