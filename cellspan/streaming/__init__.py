"""Stateful observers, their batch replay and the Structured Streaming forms."""
