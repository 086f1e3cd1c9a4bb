"""Metric state over a stream of prediction batches."""
