"""Column expressions and driver-side numbers that the operators are built from."""
