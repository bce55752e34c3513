"""Brindle: document processing, vector retrieval and corpus analytics as PySpark DataFrame operators."""
