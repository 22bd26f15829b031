"""functions of the span engine."""
