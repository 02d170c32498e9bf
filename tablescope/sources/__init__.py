"""Folder readers and writers."""
