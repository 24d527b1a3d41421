"""streaming of the change-risk engine."""
