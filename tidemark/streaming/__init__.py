"""Structured Streaming: stateful thinning and roll-ups."""
