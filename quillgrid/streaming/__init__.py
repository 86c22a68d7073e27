"""The frequent-item operators over Structured Streaming."""
