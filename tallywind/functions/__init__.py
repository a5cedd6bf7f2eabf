"""Column-to-column functions that stay inside Spark's code generation."""
