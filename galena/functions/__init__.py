"""Column functions: pure expressions that stay in code generation."""
