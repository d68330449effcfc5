"""Training-data operators: ten corpus operators and what they share. Nothing outside this subpackage imports it."""
