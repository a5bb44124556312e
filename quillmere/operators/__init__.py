"""Catalog, search and ingest as DataFrame plans."""
