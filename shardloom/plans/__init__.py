"""Query building, strategy choice, schema mapping and advice."""
