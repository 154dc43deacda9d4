"""Column expressions on DNA, k-mers and counters."""
