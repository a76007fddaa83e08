"""Spark jobs for building and analysing fact-checking social graphs."""
