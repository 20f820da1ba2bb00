"""Composite plans: feature recipes, learners, fold experiments."""
