"""Readers, sinks, and the driver's tables as this library's entities."""
