"""Readers and writers; Spark lists, splits and ships the files."""
