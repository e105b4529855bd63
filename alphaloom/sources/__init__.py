"""Readers, panels and writers."""
