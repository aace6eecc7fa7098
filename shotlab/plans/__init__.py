"""Composed plans: experiment pipelines and the query catalog with SQL oracles."""
