"""functions of the change-risk engine."""
