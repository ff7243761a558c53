"""Event log input and derived-table output."""
