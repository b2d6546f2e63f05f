"""Composed plans: retrieval, maintenance and evaluation."""
