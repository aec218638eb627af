"""Scans, landing rules and sinks."""
