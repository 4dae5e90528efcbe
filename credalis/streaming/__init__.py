"""Structured Streaming: growing logs and windowed calibration."""
