"""Structured Streaming: per-chat request settings as keyed state."""
