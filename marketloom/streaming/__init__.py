"""Structured Streaming forms of the incremental stores."""
