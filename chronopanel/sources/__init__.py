"""Scans, audits and sinks."""
