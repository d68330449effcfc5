"""Query registry of the deep-image engine."""
