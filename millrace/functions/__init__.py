"""Column expressions. All are built-in Spark expressions, safe under ANSI mode."""
