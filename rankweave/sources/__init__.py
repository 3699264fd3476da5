"""Readers, adapters to the unified schema, and sinks."""
