"""Candidate sources, table bridges and file sinks."""
