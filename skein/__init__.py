"""Skein: a comment-analytics engine expressed as Spark DataFrame plans."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
