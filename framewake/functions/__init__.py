"""Column functions: rounding, labels, times, text, JSON answers and frame geometry."""
