"""Readers and writers of position reports."""
