"""Column expressions shared by the operators. All of them are built from Spark's own functions."""
