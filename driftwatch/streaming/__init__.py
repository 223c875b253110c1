"""Streaming entry point: the row rules applied to files as they land."""

from .landing_watch import snapshot_stream, start_row_checks

__all__ = ["snapshot_stream", "start_row_checks"]
