"""No streaming operator: the inventory has none, all inputs are bounded tables."""
