"""Structured Streaming jobs over a landing folder of feed documents."""
