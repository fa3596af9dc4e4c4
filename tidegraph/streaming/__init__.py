"""Change batches through Structured Streaming."""
