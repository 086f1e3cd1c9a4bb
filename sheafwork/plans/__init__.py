"""Whole jobs: feature builders, evaluation, and the registered queries."""
