"""Decision plans for the seven levels."""
