"""Workspace-document analytics on Spark: hierarchies, queues, rendering, indexing, events."""

__version__ = "0.1.0"
