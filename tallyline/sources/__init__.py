"""Reading the tables."""
