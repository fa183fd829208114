"""Composite plans: the catalog pipeline, standalone enrichment, the driver's queries."""
