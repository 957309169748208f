"""Readers and idempotent sinks."""
