"""Structured Streaming over worker messages and telemetry."""
