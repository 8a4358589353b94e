"""Structured Streaming jobs: feeds, change events and tasks built from followed logs."""
