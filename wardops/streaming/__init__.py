"""The change rules and activity counts as Structured Streaming jobs."""
