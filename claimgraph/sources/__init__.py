"""Readers and writers of the log and of text formats."""
