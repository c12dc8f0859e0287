"""Column-level functions used by the operators."""
