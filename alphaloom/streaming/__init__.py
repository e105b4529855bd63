"""Structured Streaming variants of panel operators."""
