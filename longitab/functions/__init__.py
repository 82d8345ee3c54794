"""Column expressions and small helpers shared by the operators."""
