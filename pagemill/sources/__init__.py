"""Readers of captured pages and tables derived from them."""
