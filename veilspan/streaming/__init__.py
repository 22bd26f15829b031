"""streaming of the span engine."""
