"""Column helpers shared by all operators (Catalyst expressions only)."""
