"""Structured Streaming forms of tokenising, sharding, packing and metric logging."""
