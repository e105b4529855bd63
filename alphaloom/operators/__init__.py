"""Relational operators over panels: joins, labels, cross-sections, diagnostics, selection, simulation and comparison."""
