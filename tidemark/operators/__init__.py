"""DataFrame operators. Each takes its instant as an argument and runs no action."""
