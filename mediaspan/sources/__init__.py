"""Readers, sinks and adapters from the driver tables."""
