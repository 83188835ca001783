"""Sources, sinks and catalog views."""
