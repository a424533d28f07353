"""Event windows, for tables and for streams."""
