"""Incremental reuse, in batches and as a stream."""
