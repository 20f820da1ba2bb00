"""Operators on sample tables: catalogues, statistics, splits, evaluation."""
