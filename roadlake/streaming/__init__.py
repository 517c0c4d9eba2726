"""Structured Streaming operators. State is keyed, so each key has a watermark of its own."""
