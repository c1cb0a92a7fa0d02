"""Readers and writers of imaging files, through Spark's own file sources."""
