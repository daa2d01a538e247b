"""Settings and compositions of operators."""
