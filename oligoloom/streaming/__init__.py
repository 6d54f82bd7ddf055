"""Structured Streaming front end for candidate feeds."""
