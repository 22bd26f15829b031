"""operators of the span engine."""
