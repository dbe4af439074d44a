"""Column builders: geometry and scalar rules."""
