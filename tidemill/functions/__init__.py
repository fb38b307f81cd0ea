"""Column-level building blocks and the exact order statistics under them."""
