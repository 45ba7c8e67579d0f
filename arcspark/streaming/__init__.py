"""Structured Streaming: nothing here, as no graph operator has a notion of time or of a stream."""
