"""Structured Streaming forms of the tracker, the command fold and the journal."""
