"""Structured Streaming over the same operators; an extension, the batch tables need none of it."""
