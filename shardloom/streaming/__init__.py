"""Structured Streaming counterparts of the log and sync operators."""
