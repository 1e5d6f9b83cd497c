"""Column expressions and exact distributed statistics shared by the operators."""
