"""Scans, sinks and formats."""
