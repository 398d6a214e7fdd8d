"""Column functions without user code."""
