"""operators of the change-risk engine."""
