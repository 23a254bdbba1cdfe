"""Event-time streaming over the same kinds of steps: an extension for unbounded tables."""

from .windows import deduplicated, session_counts, windowed

__all__ = ["deduplicated", "session_counts", "windowed"]
