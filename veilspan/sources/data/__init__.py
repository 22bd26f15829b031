"""Fixed values of the engine: rules, and settings of detection."""
