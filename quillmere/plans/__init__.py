"""Whole queries and the engine that users call."""
