"""Sources of events, and encoders of results."""
