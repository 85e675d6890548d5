"""Readers and writers of messages, crops and frames."""
