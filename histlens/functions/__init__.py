"""Text and JSON forms of histories."""
