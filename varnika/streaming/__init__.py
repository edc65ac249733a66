"""Structured Streaming forms: event summaries, exactly-once stages, bounded conversation state."""
