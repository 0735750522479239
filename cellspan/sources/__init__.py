"""Sources, cleaning and sinks."""
