"""Sinks: the document store and the query log."""
