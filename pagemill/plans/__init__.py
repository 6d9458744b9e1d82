"""Whole jobs: the registered queries."""
