"""Operators over graphs, lines, findings and snapshots."""
