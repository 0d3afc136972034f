"""Sources and sinks of the archive."""
