"""Structured Streaming forms of the hourly panel and of refractory alerts (additions to the batch operators)."""
