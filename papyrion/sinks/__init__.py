"""Rendered forms of documents."""
