"""Tables, reports and checks."""
