"""sources of the change-risk engine."""
