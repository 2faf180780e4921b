"""Structured Streaming: ingest to several sinks, live series state, ingest rate."""
