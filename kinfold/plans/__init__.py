"""Whole analyses, and the test panel with its queries."""
