"""plans of the change-risk engine."""
