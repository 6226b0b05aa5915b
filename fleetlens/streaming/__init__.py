"""Structured Streaming forms of the operators that wait on live state."""

from fleetlens.streaming.readiness import stream_time_to_ready

__all__ = ["stream_time_to_ready"]
