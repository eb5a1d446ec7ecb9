"""Column functions and small helpers that the operators share."""
