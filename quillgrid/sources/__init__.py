"""Readers and shaping of documents, points and items."""
