"""plans of the span engine."""
