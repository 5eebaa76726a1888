"""Structured Streaming counterparts of incremental operators."""
