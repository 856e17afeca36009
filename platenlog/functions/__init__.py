"""Column functions and the fixed code tables."""
