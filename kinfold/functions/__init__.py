"""Column expressions and the numeric solvers."""
