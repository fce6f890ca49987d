"""Sources and sinks as Python data sources."""
