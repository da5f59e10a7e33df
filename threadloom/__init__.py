"""Conversation-memory analytics on Spark: storing, searching, grading and cleaning chat histories as DataFrames."""

__version__ = "0.1.0"
