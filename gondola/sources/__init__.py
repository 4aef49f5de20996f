"""Readers, the loader, and sinks."""
