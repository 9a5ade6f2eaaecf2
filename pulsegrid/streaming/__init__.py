"""Rates and aggregates over unbounded samples, with Structured Streaming."""

from .windows import stream_rate, stream_windows

__all__ = ["stream_rate", "stream_windows"]
