"""Pages that arrive over time."""
