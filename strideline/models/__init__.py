"""Model search, filters and scores."""
