"""Readers: history files, event tables, generated histories."""
