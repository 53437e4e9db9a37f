"""DataFrame operators of the review engine."""
