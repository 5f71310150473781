"""Readers, payload normalisers, index tables and report sinks."""
