"""sources of the span engine."""
