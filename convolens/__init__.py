"""Conversation analytics on Spark: DataFrame-to-DataFrame operators over segments, turns, classifications and documents."""

__version__ = "0.1.0"
