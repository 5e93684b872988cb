"""Operators over histories' long tables, all DataFrame to DataFrame."""
