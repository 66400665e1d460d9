"""Batch registry, lineage and data contracts."""
