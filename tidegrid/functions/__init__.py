"""Column expressions over single cells."""
