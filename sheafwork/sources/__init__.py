"""Catalogs, split-addressed scans and feature tables on disk."""
