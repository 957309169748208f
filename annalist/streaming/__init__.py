"""Stateful folds and Structured Streaming variants."""
