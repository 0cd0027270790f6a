"""Readers of telemetry formats and table adapters."""
