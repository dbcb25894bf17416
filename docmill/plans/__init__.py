"""Extraction plans: one module per document type, the registry and the end-to-end jobs."""
