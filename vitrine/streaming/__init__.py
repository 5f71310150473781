"""Structured Streaming operators; each also accepts a batch DataFrame where noted."""
