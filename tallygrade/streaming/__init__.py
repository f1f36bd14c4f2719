"""Structured Streaming views over the events of running jobs."""
