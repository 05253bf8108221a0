"""Column functions: every rule as a JVM-side expression, no Python per row."""
