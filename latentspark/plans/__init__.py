"""Queries: one module per family, each with functions of (spark, sf_dir)."""
