"""Live rainfall as Structured Streaming jobs."""
