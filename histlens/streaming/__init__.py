"""Checks over streams of recorded events."""
